"""The verdict policy: ordered caps and floors on a probability, tiers, overrides and reasons.

Every rule is a Column expression that reads the value so far, so the whole policy is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.functions.text import MAX_CHARS, MIN_CHARS, non_ascii_share, rounded

SCAM, SUSPICIOUS = 0.60, 0.40
TONES = ("tone_urgency", "tone_fear", "tone_reward", "tone_threat")


@dataclass(frozen=True)
class Rule:
    name: str
    when: str
    cap: float | None = None
    floor: float | None = None

    def sql(self, p: str) -> str:
        bound = f"least({p}, {self.cap}D)" if self.cap is not None else f"greatest({p}, {self.floor}D)"
        return f"CASE WHEN {self.when} THEN {bound} ELSE {p} END"


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


CLEAN = "malicious = 0 AND suspicious = 0 AND NOT flagged"
NO_TONE = " AND ".join(f"{t} = 0" for t in TONES)
NO_URL = "url_suspicious_tld = 0 AND url_suspicious_keyword = 0 AND url_has_ip = 0"

#: In order; "p" in a condition is the probability so far.
POLICY = (
    Rule("cap_trusted", f"trusted AND {CLEAN}", cap=0.35),
    Rule("cap_legit_signal", f"legit_phrase_score >= 1 AND {NO_TONE} AND {NO_URL} AND scam_phrase_score = 0 AND sender_impersonation_score = 0 AND malicious = 0", cap=0.30),
    Rule("floor_reward_currency", "tone_reward >= 2 AND currency_symbol_count >= 2 AND NOT trusted", floor=0.72),
    Rule("floor_type_phrase", f"NOT trusted AND ((scam_type IN {_in(rules.STRONG_TYPES)} AND scam_phrase_score >= 2) OR (scam_type NOT IN {_in(rules.STRONG_TYPES)} AND scam_type IN {_in(rules.MILD_TYPES)} AND scam_phrase_score >= 1))", floor=0.72),
    Rule("floor_phrase2", "scam_phrase_score >= 2 AND NOT trusted", floor=0.72),
    Rule("floor_investment_tone", "scam_type = 'investment_scam' AND tone_reward >= 1 AND NOT trusted", floor=0.72),
    Rule("floor_url_phrase", "url_suspicious_keyword = 1 AND scam_phrase_score >= 1 AND NOT trusted", floor=0.72),
    Rule("floor_lookalike", "sender_impersonation_score >= 2 AND NOT trusted", floor=0.72),
    Rule("cap_otp", "otp AND malicious = 0 AND NOT flagged", cap=0.25),
    Rule("floor_romance", f"romance >= 2 AND outreach >= 1 AND NOT trusted AND legit_phrase_score < 2 AND malicious = 0 AND NOT flagged", floor=0.72),
    Rule("floor_romance_mild", f"NOT (romance >= 2 AND outreach >= 1 AND NOT trusted AND legit_phrase_score < 2 AND malicious = 0 AND NOT flagged) AND romance >= 1 AND outreach >= 1 AND scam_type = 'romance_scam' AND p < 0.45D AND NOT trusted", floor=0.45),
    Rule("floor_soft_invest", "soft_invest >= 3 AND NOT trusted AND legit_phrase_score < 2", floor=0.72),
    Rule("floor_soft_invest_mild", "NOT (soft_invest >= 3 AND NOT trusted AND legit_phrase_score < 2) AND soft_invest >= 2 AND p < 0.45D AND NOT trusted", floor=0.45),
)


def apply_policy(df: DataFrame, prob: str = "prob", policy: tuple[Rule, ...] = POLICY) -> DataFrame:
    """Adds the probability after each rule (``p_<rule>``) and the final ``p``."""
    out, last = df.withColumn("p", F.col(prob)), "p"
    for rule in policy:
        out = out.withColumn("p", F.expr(rule.sql("p"))).withColumn(f"p_{rule.name}", F.col("p"))
    return out.withColumn("p", F.col(last))


def confidence_pct(p: Column) -> Column:
    return rounded(F.least(F.greatest(p * 100.0, F.lit(2.0)), F.lit(98.0)), 2)


def verdict_tier(p: Column, threshold: float = SUSPICIOUS) -> Column:
    return F.when(p >= SCAM, "SCAM").when(p >= threshold, "SUSPICIOUS").otherwise("LEGIT")


def override_reputation(verdict: Column, confidence: Column) -> tuple[Column, Column]:
    flagged, malicious = F.col("flagged"), F.col("malicious")
    one = (malicious == 1) & (verdict == "LEGIT")
    new = F.when(flagged | (malicious >= 2), "SCAM").when(one, "SUSPICIOUS").otherwise(verdict)
    sure = F.when(flagged, F.greatest(confidence, F.lit(85.0))).when(malicious >= 2, F.greatest(confidence, F.lit(75.0))).when(one, F.greatest(confidence, F.lit(55.0))).otherwise(confidence)
    return new, sure


def override_url(verdict: Column, confidence: Column) -> tuple[Column, Column]:
    base = (verdict == "LEGIT") & (F.col("n_urls") > 0) & ~F.col("trusted")
    marked = base & ((F.col("url_suspicious_tld") == 1) | (F.col("url_suspicious_keyword") == 1))
    ip = base & ~marked & (F.col("url_has_ip") == 1)
    new = F.when(marked | ip, "SUSPICIOUS").otherwise(verdict)
    return new, F.when(marked, F.greatest(confidence, F.lit(50.0))).when(ip, F.greatest(confidence, F.lit(55.0))).otherwise(confidence)


#: Reason codes in order of weight, with their conditions: a strong and a weak form of a signal exclude each other.
REASONS = (
    ("dangerous_link", "malicious > 0 OR flagged"),
    ("ip_link", "url_has_ip = 1"),
    ("fake_company_link", "sender_impersonation_score >= 2"),
    ("odd_suffix_link", "url_suspicious_tld = 1"),
    ("unsolicited_contact", "romance >= 2"),
    ("vague_returns", "soft_invest >= 3"),
    ("strong_urgency", "tone_urgency >= 2"),
    ("urgency", "tone_urgency = 1"),
    ("strong_fear", "tone_fear >= 2"),
    ("fear", "tone_fear = 1"),
    ("strong_reward", "tone_reward >= 2"),
    ("reward", "tone_reward = 1"),
    ("threat", "tone_threat >= 1"),
    ("known_phrases", "scam_phrase_score >= 2"),
    ("known_phrase", "scam_phrase_score = 1"),
)
#: The dashboard's list: everything that holds.
DASHBOARD = (
    ("urgency", "tone_urgency > 0"),
    ("fear", "tone_fear > 0"),
    ("reward", "tone_reward > 0"),
    ("threat", "tone_threat > 0"),
    ("known_phrases", "scam_phrase_score > 0"),
    ("impersonation", "sender_impersonation_score > 0"),
    ("ip_link", "url_has_ip = 1"),
    ("odd_suffix_link", "url_suspicious_tld = 1"),
    ("link_keyword", "url_suspicious_keyword = 1"),
    ("flagged_link", "flagged"),
    ("malicious_link", "malicious > 0 AND NOT flagged"),
    ("near_known_scams", "proximity_score > 0.65D"),
)


def _held(reasons: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    held = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(code)) for code, cond in reasons]))
    return F.when(F.size(held) > 0, held).otherwise(otherwise)


def why_flagged(first: int = 3, reasons: tuple[tuple[str, str], ...] = REASONS, default_type: str = rules.DEFAULT_TYPE) -> Column:
    """The first reasons that hold, joined by a bar. Without any, a verdict other than legit is explained by its type."""
    by_type = F.when(F.col("scam_type") != default_type, F.array(F.concat(F.lit("like_"), "scam_type"))).otherwise(F.array(F.lit("subtle_patterns")))
    none = F.when(F.col("verdict") == "LEGIT", F.expr("cast(array() as array<string>)")).otherwise(by_type)
    return F.array_join(F.slice(_held(reasons, none), 1, first), "|")


def dashboard_reasons(reasons: tuple[tuple[str, str], ...] = DASHBOARD) -> Column:
    by_nearness = F.when(F.col("proximity_score") > 0.50, F.lit("proximity_elevated")).otherwise(F.lit("subtle_patterns"))
    none = F.array(F.when(F.col("verdict") == "LEGIT", F.lit("none")).otherwise(by_nearness))
    return F.array_join(_held(reasons, none), "|")


#: What each reason code says to a reader; {link} is the message's first link.
REASON_TEXTS = {
    "dangerous_link": "A link service lists {link} as dangerous.",
    "ip_link": "The address of {link} is a bare number; companies use names.",
    "fake_company_link": "{link} borrows the name of a company that does not own it.",
    "odd_suffix_link": "{link} ends in a suffix that is cheap to register and often abused.",
    "unsolicited_contact": "A stranger opens a personal talk, which often precedes a request for money.",
    "vague_returns": "Gains are hinted at without terms, and a private answer is asked for.",
    "strong_urgency": "The text presses for action at once, several times.",
    "urgency": "The text presses for action at once.",
    "strong_fear": "Loss of an account or of access is threatened several times.",
    "fear": "Loss of an account or of access is threatened.",
    "strong_reward": "Prizes or sure gains are promised several times.",
    "reward": "A prize or a sure gain is promised.",
    "threat": "The text threatens with police, courts or exposure.",
    "known_phrases": "Several phrases are common in known fraud.",
    "known_phrase": "One phrase is common in known fraud.",
    "subtle_patterns": "No single sign stands out, but the text as a whole resembles known fraud.",
}


def reason_texts(codes: str = "why_flagged", urls: str = "urls", texts: dict[str, str] = REASON_TEXTS) -> Column:
    """The sentences of a row's reason codes, in their order. Codes ``like_<type>`` name the type."""
    table = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    link = F.coalesce(F.get(urls, F.lit(0)), F.lit("a link"))
    like = lambda c: F.concat(F.lit("The text reads like a case of "), F.replace(F.substring(c, 6, 100), F.lit("_"), F.lit(" ")), F.lit("."))
    each = F.filter(F.split(F.coalesce(codes, F.lit("")), "[|]"), lambda c: c != "")
    return F.transform(each, lambda c: F.when(F.startswith(c, F.lit("like_")), like(c)).otherwise(F.replace(F.coalesce(F.try_element_at(table, c), c), F.lit("{link}"), link)))


def prediction_record() -> dict[str, Column]:
    """The 25 fields, lists as arrays and contributions as a map, from the columns of :func:`verdicts` and ``text``, ``leet``
    (the normalised text), ``urls``, ``proximity_score``, ``contributions``, ``threat_type`` and ``key_present`` (whether the
    first link service could be asked). Texts below the least length have a record of their own."""
    short = F.char_length(F.trim("text")) < MIN_CHARS
    key, n = F.coalesce("key_present", F.lit(False)), F.col("n_urls")
    second = ~F.col("flagged") & (F.col("malicious") + F.col("suspicious") > 0)
    warned = F.array_compact(F.array(
        F.when(short, "too_short"), F.when(~short & (F.char_length("text") > MAX_CHARS), "long_text"), F.when(~short & (non_ascii_share(F.col("text")) > 0.30), "non_english"),
        F.when(~short & (n > 0) & ~key & ~second, "reputation_skipped"),
    ))
    no_list, no_map = F.array().cast("array<string>"), F.create_map().cast("map<string,double>")

    def unless(c: Column | str, none=0) -> Column:
        return F.when(short, none if isinstance(none, Column) else F.lit(none)).otherwise(c if isinstance(c, Column) else F.col(c))

    return {
        "verdict": unless("verdict", "TOO_SHORT"), "confidence": unless("confidence", 0.0), "threshold_used": F.lit(SUSPICIOUS), "scam_type": unless("scam_type", None), "why_flagged": unless("why_flagged", None),
        **{t: unless(t) for t in TONES}, **{k: unless(k) for k in ("url_suspicious_tld", "url_suspicious_keyword", "url_has_ip")},
        "scam_phrase_score": unless("scam_phrase_score"), "sender_impersonation": unless("sender_impersonation_score"), "proximity_score": unless("proximity_score", 0.0), "urls_found": unless("urls", no_list),
        "gsb_flagged": unless("flagged", None), "gsb_threat_type": unless(F.when(F.col("flagged"), F.col("threat_type")), None), "gsb_attempted": unless((n > 0) & key, None),
        "vt_malicious": unless("malicious"), "vt_suspicious": unless("suspicious"), "vt_attempted": unless(second, None),
        "normalized_text": unless("leet", ""), "feature_contributions": unless("contributions", no_map), "warnings": warned,
    }


def verdicts(df: DataFrame, prob: str = "prob") -> DataFrame:
    """The whole policy: p, confidence, verdict and reasons, after all overrides."""
    out = apply_policy(df, prob)
    verdict, confidence = verdict_tier(F.col("p")), confidence_pct(F.col("p"))
    out = out.withColumns({"verdict": verdict, "confidence": confidence})
    v, c = override_reputation(F.col("verdict"), F.col("confidence"))
    out = out.withColumns({"verdict": v, "confidence": c})
    v, c = override_url(F.col("verdict"), F.col("confidence"))
    return out.withColumns({"verdict": v, "confidence": c}).withColumn("why_flagged", why_flagged())


def display_confidence(verdict: Column, confidence: Column) -> Column:
    """What a reader sees: how sure the verdict is; unknown verdicts read as legit."""
    shown = F.when(verdict.isin("SCAM", "SUSPICIOUS"), confidence).otherwise(F.lit(100.0) - confidence)
    return F.least(F.greatest(shown, F.lit(0.0)), F.lit(100.0))


def score_band(score: Column) -> Column:
    """Half-open bands at 26, 51 and 75."""
    return F.when(score < 26, "low").when(score < 51, "moderate").when(score < 75, "high").otherwise("critical")


def proximity_band(score: Column) -> Column:
    return F.when(score > 0.65, "high").when(score > 0.45, "medium").otherwise("low")
