"""Starter rule pack. Every scorer takes its rules as an argument; these are the defaults.

Patterns are written for this package, in what Java and RE2 read alike: ASCII classes and word borders, no look-around.
Lists under "Fixed values" are what results must agree on: host names, suffixes, signs and the words of the link tests.
"""

from __future__ import annotations


def bordered(*words: str) -> tuple[str, ...]:
    """Patterns that match only between word borders."""
    return tuple(rf"\b(?:{w})\b" for w in words)


_MONEY = r"[$€£][0-9,]+"
TONE = {
    "urgency": bordered(
        "urgent(?:ly)?", "act (?:now|fast)", "immediately", "final (?:notice|warning)", "expires? (?:today|soon|tonight)", "right away", "last chance", "limited time", "within [0-9]+ hours",
        "deadline", "asap", "hurry", "today only", "do not (?:wait|delay|ignore)", "time is running out", "reply (?:now|immediately)",
    ),
    "fear": bordered(
        "(?:account|card|access).{0,25}(?:suspended|blocked|locked)", "(?:suspicious|unusual) (?:activity|login|payment)", "verify your (?:account|identity|card|details)", "unauthorized (?:access|login|charge)",
        "security (?:alert|warning|notice)", "compromised", "failed (?:login|payment)", "has a virus", "data breach",
    ),
    "reward": bordered(
        "you (?:have )?won", "you (?:are|have been) (?:selected|chosen)", "cash prize", "(?:claim|collect) your (?:prize|reward|gift|bonus)", "guaranteed (?:profit|returns?|income)", "double your",
        "free (?:gift|money|cash|phone|trip)", "lucky (?:winner|draw)", "congratulations.{0,40}(?:won|selected|prize)", "weekly returns?", "instant payout", "risk[ -]free profit",
    ) + (rf"\b(?:earn|make) {_MONEY}", rf"{_MONEY} (?:guaranteed|bonus|reward)\b", rf"{_MONEY} into {_MONEY}"),
    "threat": bordered(
        "legal action", "(?:will be|be) arrested", "arrest you", "(?:file|filed) a lawsuit", "court (?:order|hearing|date)", "debt collector", "arrest warrant", "prosecuted", "fined", "criminal charges?", "penalty fee", "unless you (?:pay|confirm|act)",
    ),
}
#: Words of the older tone counts.
TONE_LEGACY = {
    "urgency": ("urgent", "immediately", "expires", "limited time", "act now", "hurry", "deadline", "last chance", "asap"),
    "fear": ("suspended", "blocked", "unauthorized", "suspicious activity", "verify your account", "locked", "compromised"),
    "reward": ("winner", "won", "prize", "reward", "gift card", "free", "congratulations", "selected", "claim your", "bonus"),
    "threat": ("legal action", "arrested", "police", "lawsuit", "penalty", "fined", "criminal", "court"),
}
#: Words that void a tone match when one is among the six before it.
NEGATORS = ("not", "no", "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "never", "neither", "nor", "nothing", "none", "cannot", "can't", "won't", "wouldn't", "shouldn't", "couldn't")

#: Emoji and the words they stand for.
EMOJI = {
    "🎁": "gift", "🚨": "alert", "⚠️": "warning", "💰": "money", "🏆": "trophy", "🎉": "prize", "💵": "cash", "🔐": "secure", "⏰": "urgent", "📧": "email", "🎊": "prize", "💳": "card",
    "🔒": "locked", "✅": "verified", "❌": "error", "🆓": "free", "💎": "diamond", "🌟": "star", "🎰": "lottery", "📱": "phone", "🏦": "bank", "💸": "money", "🎯": "target", "🔑": "key",
}
#: Look-alike characters and letters.
LEET = ("01345678@$", "oieasgtbas")
#: Hosts of shortened links.
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "ow.ly", "goo.gl", "short.link", "rb.gy", "cutt.ly", "is.gd", "buff.ly")

#: Cues of the stored urgency count.
CUES = ("urgent", "verify", "suspended", "act now", "winner", "claim", "prize", "immediately")
CUES_GAP = (*CUES, "refund", "parcel")

#: Suffixes and words of the link tests, and of the older tests.
TLDS = (".xyz", ".top", ".club", ".online", ".site", ".info", ".biz", ".tk", ".ml", ".ga", ".cf", ".pw")
TLDS_LEGACY = TLDS[:11]
URL_KEYWORDS = (
    "login", "verify", "secure", "account", "update", "confirm", "banking", "paypal", "amazon", "apple", "microsoft", "support", "signin", "validate", "unlock", "restore", "reactivate",
    "suspended", "blocked", "portal", "credential", "webmail", "apply", "staffing", "recovery", "refund", "renewal", "forgiveness", "warranty", "approval", "relief", "claim", "dispute",
)
URL_KEYWORDS_LEGACY = URL_KEYWORDS[:10]
#: Suffixes of host names that are written without a scheme.
BARE_SUFFIXES = ("com", "org", "net", "gov", "edu", "io", "co.uk", "ac.il")
#: Brands and the domains that are theirs.
BRANDS = {
    "apple": ("apple.com", "icloud.com"), "google": ("google.com",), "microsoft": ("microsoft.com", "live.com"), "amazon": ("amazon.com", "amazon.co.uk", "amazon.de", "amazon.fr", "amazon.co.jp"),
    "paypal": ("paypal.com",), "netflix": ("netflix.com",), "facebook": ("facebook.com", "fb.com"), "instagram": ("instagram.com",), "whatsapp": ("whatsapp.com", "wa.me"), "samsung": ("samsung.com",),
    "adobe": ("adobe.com",), "dropbox": ("dropbox.com",), "linkedin": ("linkedin.com",), "github": ("github.com", "githubusercontent.com"), "binance": ("binance.com",), "zoom": ("zoom.us",),
    "spotify": ("spotify.com",), "twitter": ("twitter.com", "x.com"), "tiktok": ("tiktok.com",), "ebay": ("ebay.com",),
}
#: Action words in host names.
HOST_ACTIONS = ("verify", "unlock", "login", "signin", "secure", "confirm", "validate", "authenticate", "portal", "apply", "activate", "restore", "update", "claim", "recovery", "refund", "approval", "renewal", "dispute")
#: Domains whose links are trusted by default: those of the brands above, and some public bodies. Larger lists are tables
#: (operators/domains.py).
TRUSTED = (*dict.fromkeys(d for own in BRANDS.values() for d in own), "iana.org", "ietf.org", "w3.org", "wikipedia.org", "apache.org", "python.org", "europa.eu", "who.int", "irs.gov")
#: Names and actions of the impersonation score.
IMPERSONATED = ("paypal", "amazon", "apple", "microsoft", "netflix", "bank", "fedex", "irs", "google", "dhl", "hsbc", "chase")
IMPERSONATION_ACTIONS = ("verify", "confirm", "suspended", "login", "update", "locked", "blocked", "validate", "reactivate", "authenticate")


def _phrases(*groups: tuple[str, str]) -> tuple[str, ...]:
    """All phrases "first second" of groups of alternatives with | between them, each once, in order."""
    return tuple(dict.fromkeys(f"{a} {b}" for first, second in groups for a in first.split("|") for b in second.split("|")))


#: Phrases by rule: verbs x objects.
PHRASES = _phrases(
    ("verify your|confirm your|update your|restore your|unlock your", "account|identity|card|details|payment|password|bank details"),
    ("your account is|your card is|your access is|your account has been", "suspended|locked|limited|blocked"),
    ("claim your|collect your|redeem your", "prize|reward|gift|bonus|refund|voucher"),
    ("you have won|you won|chance to win", "a prize|a cash prize|a car|a gift card|the lottery"),
    ("guaranteed|risk free|weekly|daily", "profit|profits|returns|income"),
    ("double your|triple your|grow your", "money|bitcoin|investment|savings"),
    ("work from home|earn from home|paid every week", "and earn|no experience|no experience needed"),
    ("held at|stopped at|waiting at", "customs|the depot|the warehouse"),
    ("pay the|pay a small|settle the", "delivery fee|customs fee|shipping fee|processing fee|release fee"),
    ("submit your|send your|share your", "ssn|pin|passport|bank account|one-time code"),
    ("file a|face a|pending", "lawsuit|court case|arrest warrant"),
    ("your computer|your phone|your device", "has a virus|is infected|was hacked"),
    ("call microsoft|call our|contact our", "support|support now|support team"),
    ("are you|i am", "single and looking|a widow|stationed abroad"),
    ("crypto|forex|bitcoin", "trading platform|trading group|signals group"),
    ("act|respond|reply", "now or|today or|before midnight"),
    ("small|one-time", "investment today|activation fee|registration fee"),
) + ("final warning", "double your bitcoin", "great return", "wire the money", "buy gift cards", "scan the qr code", "your sim card will", "i need your help urgently", "keep this confidential", "next of kin")
#: Phrases of service mail by rule: things x what became of them weigh 1, what a sender with ill intent leaves out weighs 2.
LEGIT_PHRASES = dict.fromkeys(
    _phrases(
        ("your order|your parcel|your booking|your ticket|your appointment|your refund", "is confirmed|was confirmed|has shipped|was delivered|is ready|has been processed"),
        ("receipt|invoice|itinerary|agenda|minutes", "attached|enclosed|is ready|is below"),
        ("your statement|your bill|your timesheet|your transcript", "is ready|is available|was received"),
        ("thank you for|thanks for", "your order|your payment|your visit|your business|shopping with us|joining us"),
        ("see you|we meet|the call is", "on monday|on tuesday|on wednesday|on thursday|on friday|tomorrow|next week"),
    ),
    1,
) | dict.fromkeys(
    _phrases(
        ("do not share|never share|do not forward", "this code|this pin|your code|your pin"),
        ("no action|nothing more|no reply", "is needed|is required|to do"),
        ("we will never|our staff never", "ask for your|ask for this|call you"),
    ),
    2,
)

#: In order of declaration, which decides ties. Names are fixed values.
SCAM_TYPES = {
    "phishing": (*bordered("(?:paypal|amazon|netflix|apple|google).{0,60}(?:verify|confirm|suspended|locked)", "account.{0,40}(?:suspended|limited|locked)", "verify (?:your|now)", "update your details"),),
    "credential_phishing": bordered("(?:password|mailbox).{0,30}(?:expires?|reset|quota)", "(?:log|sign) ?in (?:here|below|at)", "re-?enter your (?:password|credentials)", "submit your (?:ssn|pin|password)", "enter your (?:password|login)"),
    "emergency_scam": bordered("(?:grandma|grandpa|mom|mum|dad).{0,40}(?:accident|jail|hospital|new number)", "bail money", "stuck (?:abroad|at the airport)", "i lost my phone"),
    "prize_fraud": bordered("you (?:have )?won", "cash prize", "claim your (?:reward|prize)", "you (?:are|have been) selected", "lottery"),
    "bank_impersonation": bordered("bank.{0,40}(?:fraud|unusual|blocked|verify)", "fraud department", "your (?:debit|credit) card.{0,30}(?:blocked|charged|locked)", "zelle|wire transfer"),
    "job_scam": bordered("work from home", "no experience(?: needed)?", "hiring (?:now|immediately)", "remote job", "per (?:day|week).{0,20}(?:job|work|earn)") + (rf"\b(?:earn|make) {_MONEY}",),
    "investment_scam": bordered("guaranteed (?:profit|returns?)", "double your", "bitcoin|crypto", "great return", "trading (?:platform|bot|signals)", "passive income"),
    "romance_scam": bordered("are you single", "widow(?:er)?", "stationed abroad", "h(?:i|ello) dear", "true love", "soulmate", "looking for (?:a )?(?:real|serious) relationship"),
    "advance_fee_scam": bordered("next of kin", "inheritance", "(?:million|funds).{0,40}(?:transfer|release)", "release fee", "beneficiary"),
    "delivery_scam": bordered("parcel", "held at customs", "(?:delivery|shipping) fee", "could not be delivered", "reschedule (?:your )?delivery"),
    "social_media_scam": bordered("your (?:page|profile).{0,40}(?:copyright|violat|removed)", "free followers", "copyright (?:claim|strike)", "verified badge"),
    "threat_scam": bordered("lawsuit", "arrest(?:ed)?", "tax (?:refund pending|debt|fraud)", "irs notice", "police.{0,30}warrant", "i (?:recorded|hacked) you"),
    "pig_butchering": bordered("uncle.{0,30}(?:taught|trades?)", "show you how (?:i|to) (?:trade|invest)", "crypto trading.{0,60}(?:great return|profit)", "wrong number.{0,80}(?:friend|nice to meet)"),
    "qr_phishing": bordered("scan (?:the|this) (?:qr )?code", "qr code.{0,40}(?:verify|pay|login)", "mfa.{0,30}scan"),
    "refund_scam": bordered("refund (?:pending|is waiting|department)", "overpaid", "tax refund", "auto-?renew(?:al|ed).{0,40}(?:call|cancel)"),
    "sim_swap": bordered("sim (?:card|swap).{0,40}(?:deactivat|replac|port)", "port(?:ing)? your number", "esim.{0,30}(?:activate|confirm)"),
}
DEFAULT_TYPE = "general_spam"
#: How many of the first patterns are ways to start a talk; the others are stories that such talks tell.
OUTREACH = 8
ROMANCE = bordered(
    "i saw your (?:profile|photos?|pictures?)", "your (?:smile|eyes|photos?) (?:caught|made|are|is)", "meant (?:to text|this) for", "is this still [a-z]+'s (?:phone|number)", "are you (?:single|seeing anyone)",
    "(?:write|talk|chat) (?:to me )?on (?:telegram|signal|another app)", "(?:dear|darling|sweetheart|honey)", "fate (?:brought|made) us",
    "(?:oil|drilling) (?:rig|platform)", "(?:medical|relief|rescue) mission", "stationed (?:abroad|overseas)|deployed", "widow(?:er)?|lost my (?:wife|husband)", "(?:customs|hospital) (?:hold|holds|bill)", "once i (?:come home|get leave)",
)
SOFT_INVEST = bordered(
    "(?:uncle|aunt|mentor|coach).{0,30}(?:taught|trades|guides)", "(?:great|steady|weekly) (?:return|payout)s?", "let me show you", "(?:dm|message|text) me", "(?:quit|left) my (?:job|nine to five)",
    "paid off my (?:loan|house|debts?)", "(?:small|first) deposit", "withdraw (?:any time|whenever)", "(?:screenshots?|proof) of (?:profit|payouts?)", "spots? (?:left|remaining)", "(?:crypto|forex|options) (?:trading|signals)",
)
#: Types by how many phrases confirm them.
STRONG_TYPES = ("romance_scam", "advance_fee_scam", "delivery_scam", "credential_phishing", "emergency_scam", "bank_impersonation", "threat_scam")
MILD_TYPES = ("social_media_scam", "investment_scam")

LURES = (
    "Your account needs attention: {url}", "Please review this notice: {url}", "You have a pending payment, see {url}", "Package update: {url}",
    "Confirm your details here {url}", "Security alert, sign in at {url}", "Your refund is waiting: {url}",
)
