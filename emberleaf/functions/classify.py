"""Significance, semantic fields, topic signatures and pattern detectors as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberleaf.functions import lexicon
from emberleaf.functions.text import let, literal_array, text


def significance(c: Column | str) -> Column:
    """0.3, or more for texts of decisions, importance, errors or more than 2,000 bytes."""
    low = F.lower(text(c))
    some = lambda *words: F.greatest(*(F.contains(low, F.lit(w)) for w in words))
    return F.when(some("decision", "decided", "because"), 0.85).when(some("critical", "important", "must"), 0.8).when(some("error", "fix", "bug"), 0.6).when(F.octet_length(text(c)) > 2000, 0.5).otherwise(0.3)


def words(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def found(low: Column, own: Column, terms: Sequence[str]) -> Column:
    """Which of ``terms`` occur, in their order, in a lower-cased text of the words ``own``: as whole words, or as substrings if they have a space or _.

    Words are looked up in a hash set of the text's; the text is searched for the others alone.
    """
    terms = list(dict.fromkeys(terms))
    phrases = [t for t in terms if " " in t or "_" in t]
    held = F.filter(literal_array(phrases), lambda t: F.contains(low, t)) if phrases else literal_array([])
    return F.array_intersect(literal_array(terms), F.concat(F.array_except(own, literal_array(phrases)), held))


def among(hits: Column, terms: Sequence[str]) -> Column:
    """Those of ``terms`` that are in ``hits``, in the order of ``terms``."""
    return F.array_intersect(literal_array(list(dict.fromkeys(terms))), hits)


def classes(hits: Column, table: list[tuple[str, str]]) -> Column:
    """Sorted distinct classes of the words ``hits``."""
    of: dict[str, list[str]] = {}
    for w, c in table:
        of.setdefault(c, []).append(w)
    pick = lambda h: F.filter(F.array(*(F.when(F.arrays_overlap(h, literal_array(ws)), F.lit(c)) for c, ws in sorted(of.items()))), lambda x: x.isNotNull())
    return let(hits, pick)


def _polarity(hits: Column) -> Column:
    count = lambda terms: F.size(among(hits, terms))
    return let(count(lexicon.NEGATIVE) - count(lexicon.POSITIVE), lambda d: F.when(d > 2, "negative").when(d < -2, "positive").otherwise("neutral"))


def _with_words(c: Column | str, f) -> Column:
    return let(F.struct(F.lower(text(c)).alias("low"), words(c).alias("own")), lambda s: f(s["low"], s["own"]))


def polarity(c: Column | str) -> Column:
    """negative or positive if that side has more than two distinct signal words more, else neutral."""
    return _with_words(c, lambda low, own: let(found(low, own, [*lexicon.NEGATIVE, *lexicon.POSITIVE]), _polarity))


def entities(c: Column | str) -> Column:
    """Distinct all-capital words of three and mixed-case words of four bytes or more, in order."""
    parts = F.transform(F.split(text(c), r"[\s,;:()]"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$", ""))
    caps = lambda w: (F.octet_length(w) >= 3) & w.rlike(r"^[\p{Lu}0-9]+$")
    mixed = lambda w: (F.octet_length(w) >= 4) & w.rlike(r"^\p{Lu}.*\p{Lu}") & w.rlike(r"\p{Ll}")
    return F.array_distinct(F.filter(parts, lambda w: (caps(w) | mixed(w)) & ~w.isin(lexicon.NOT_ENTITIES)))


def semantics(c: Column | str) -> Column:
    """A struct of technology, category, action, domain, polarity and entities."""
    tech, domain = lexicon.pairs(lexicon.TECHNOLOGY, None), lexicon.pairs(lexicon.DOMAINS, ",")

    def fields(hits: Column) -> Column:
        tools = among(hits, [w for w, _ in tech])
        return F.struct(
            tools.alias("technology"),
            classes(tools, tech).alias("category"),
            among(hits, lexicon.ACTIONS).alias("action"),
            classes(among(hits, [w for w, _ in domain]), domain).alias("domain"),
            _polarity(hits).alias("polarity"),
            entities(c).alias("entities"),
        )

    every = [*(w for w, _ in tech), *lexicon.ACTIONS, *(w for w, _ in domain), *lexicon.NEGATIVE, *lexicon.POSITIVE]
    return _with_words(c, lambda low, own: let(found(low, own, every), fields))


def topic_terms(c: Column | str, technology: Sequence[str] = lexicon.TOPIC_TECHNOLOGY, domains: Sequence[str] = lexicon.TOPIC_DOMAINS) -> Column:
    """Topic words that the text holds as substrings; those of an area with ``domain:`` before them."""

    def terms(low: Column) -> Column:
        tech = F.filter(literal_array(technology), lambda t: F.contains(low, t))
        area = F.transform(F.filter(literal_array(domains), lambda t: F.contains(low, t)), lambda t: F.concat(F.lit("domain:"), t))
        return F.concat(tech, area)

    return let(F.lower(text(c)), terms)


def topic_kind(c: Column | str, decision: Sequence[str] = lexicon.DECISION_MARKERS) -> Column:
    """decision, incident, plan or null."""

    def kind(low: Column) -> Column:
        some = lambda ws: F.exists(literal_array(ws), lambda t: F.contains(low, t))
        return F.when(some(decision), "decision").when(some(["error", "bug", "fix"]), "incident").when(some(["todo", "task", "plan"]), "plan")

    return let(F.lower(text(c)), kind)


def first_pattern(c: Column | str, patterns: dict[str, str]) -> Column:
    """The name of the first of ``patterns`` that occurs, else null."""
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        out = F.when(text(c).rlike(p), F.lit(name)).otherwise(out)
    return out


def pii(c: Column | str) -> Column:
    return first_pattern(c, lexicon.PII)


def credential(c: Column | str) -> Column:
    return first_pattern(c, lexicon.CREDENTIALS)


def contains_secret(c: Column | str) -> Column:
    """Whether a log line holds a secret, an address or a home folder."""
    out = F.lit(False)
    for p in lexicon.AUDIT_SECRETS:
        out |= text(c).rlike(p)
    return out


def blocked_key(c: Column | str) -> Column:
    """The protected prefix of a key, else null."""
    out = F.lit(None).cast("string")
    for p in reversed(lexicon.BLOCKED_KEYS):
        out = F.when(text(c).startswith(p), F.lit(p)).otherwise(out)
    return out


def valid_hash(c: Column | str) -> Column:
    return text(c).rlike("^[0-9a-f]{64}$")


FACT = {
    "id: pattern": lambda c: c.rlike(r"^fact_[a-z0-9_]+$"),
    "namespace: enum": lambda c: c.isin("user", "tenant", "project", "system"),
    "type: enum": lambda c: c.isin("preference", "identity", "goal", "constraint", "domain_fact", "exclusion"),
    "key: pattern": lambda c: c.rlike(r"^[a-z][a-z0-9_\.]*$") & F.length(c).between(3, 128),
    "value: required": lambda c: c.isNotNull(),
    "confidence: range": lambda c: c.between(0.0, 1.0),
    "source: enum": lambda c: c.isin("explicit", "inferred", "imported"),
    "created_at: date-time": lambda c: F.try_to_timestamp(c).isNotNull(),
    "updated_at: date-time": lambda c: F.try_to_timestamp(c).isNotNull(),
    "sensitivity: enum": lambda c: c.isin("low", "medium", "high"),
}


EPISODE = {
    "id: pattern": lambda c: c.rlike(r"^ep_[a-z0-9_]+$"),
    "summary: length": lambda c: F.length(c).between(20, 1000),
    "entities: items": lambda c: F.size(c).between(1, 20) & (F.size(F.array_distinct(c)) == F.size(c)) & ~F.exists(c, lambda x: x.isNull()),
    "timestamp: date-time": lambda c: F.try_to_timestamp(c).isNotNull(),
    "importance: range": lambda c: c.between(0.0, 1.0),
    "source_conversation_id: required": lambda c: c.isNotNull(),
}
#: Columns that an episode may lack; a value that it has must hold to the rule.
EPISODE_OPTIONAL = {
    "decay_rate: range": lambda c: c.between(0.0, 1.0),
    "compacted: boolean": lambda c: c.cast("boolean").isNotNull(),
    "pinned: boolean": lambda c: c.cast("boolean").isNotNull(),
}


def episode_errors(columns: Sequence[str]) -> Column:
    """As ``schema_errors``, for episodes."""
    return schema_errors(columns, EPISODE, ("project", "follow_up"), EPISODE_OPTIONAL)


def schema_errors(columns: Sequence[str], rules: dict = FACT, allowed: Sequence[str] = ("last_confirmed_at", "expires_at", "notes", "evidence", "supersedes", "tags"), optional: dict | None = None) -> Column:
    """Messages of the rules that a row breaks, in order: one for each column that is absent, wrong or not allowed.

    ``optional`` are rules of columns that may be absent or null.
    """
    optional = {m: ok for m, ok in (optional or {}).items() if m.split(":")[0] in columns}
    allowed = (*allowed, *(m.split(":")[0] for m in optional))
    known = {m.split(":")[0] for m in rules}
    checks = [F.lit(f"{m.split(':')[0]}: missing") if m.split(":")[0] not in columns else F.when(~F.coalesce(ok(F.col(m.split(":")[0])), F.lit(False)), F.lit(m)) for m, ok in rules.items()]
    checks += [F.when(~F.coalesce(ok(F.col(m.split(":")[0])), F.lit(True)), F.lit(m)) for m, ok in optional.items()]
    checks += [F.lit(f"{c}: not allowed") for c in columns if c not in known and c not in allowed]
    return F.filter(F.array(*checks), lambda m: m.isNotNull())
