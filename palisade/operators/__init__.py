"""DataFrame-to-DataFrame operators over messages, links, chats and vectors."""
