"""Tokens, keywords, summaries and other text features as Column expressions.

All are null-safe: a null text gives what an empty one gives.
"""

from __future__ import annotations

import collections
import heapq
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberleaf.functions import lexicon


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def extract(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def trimmed(a: Column) -> Column:
    """Each element without spaces around it. F.trim itself would get an element's index as the characters to trim."""
    return F.transform(a, lambda x: F.trim(x))


def first(a: Column, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(default))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once, also where ``f`` uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def keep(a: Column, stops: Sequence[str]) -> Column:
    """The elements of ``a`` without ``stops``, in order and with repeats."""
    stop = sorted(set(stops))
    return F.filter(a, lambda w: ~w.isin(stop))


def tokens(c: Column | str) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.array_distinct(extract(F.lower(text(c)), "[a-z0-9]+"))


def session_tokens(c: Column | str) -> Column:
    """Lower-cased words of three and more characters outside fenced code and web addresses, with repeats."""
    plain = F.regexp_replace(F.regexp_replace(text(c), r"```[\s\S]*?```", ""), r"https?://\S+", "")
    return extract(F.lower(plain), "[a-zA-Z][a-zA-Z0-9_-]{2,}")


def fingerprint_tokens(c: Column | str) -> Column:
    """Words of letters, digits, - and _ that have three bytes or more and are no stop words, with repeats."""
    return F.filter(keep(F.split(F.lower(text(c)), r"[^\p{L}\p{N}_-]+"), lexicon.FINGERPRINT_STOPS), lambda w: F.octet_length(w) >= 3)


def keywords(c: Column | str) -> Column:
    """Distinct words of letters, digits and _ that have three bytes or more and are no stop words, in order."""
    return F.array_distinct(keep(F.filter(F.split(F.lower(text(c)), r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) >= 3), lexicon.INGEST_STOPS))


def term_counts(c: Column | str, most: int = 30) -> Column:
    """The ``most`` most frequent tokens longer than two characters that are no stop words, ties by code point, as (n, term)."""
    stops = frozenset(lexicon.CONTEXT_STOPS)

    @F.arrow_udf("array<struct<n:bigint,term:string>>")
    def count(low: pa.Array) -> pa.Array:
        off, n, terms = [0], [], []
        for x in low.to_pylist():
            # of runs of a-z and 0-9, the ones of three and more
            own = collections.Counter(re.findall("[a-z0-9]{3,}", x))
            for w in stops.intersection(own):
                del own[w]
            top = heapq.nsmallest(most, ((-k, w) for w, k in own.items()))
            n += [-k for k, _ in top]
            terms += [w for _, w in top]
            off.append(len(n))
        pairs = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(terms, pa.string())], ["n", "term"])
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pairs)

    return count(F.lower(text(c)))


def ranked_keywords(c: Column | str, most: int = 30) -> Column:
    return F.transform(term_counts(c, most), lambda s: s["term"])


def headers(c: Column | str) -> Column:
    """The first twenty distinct Markdown headings of levels one to three that are longer than three characters."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(trimmed(found), lambda h: F.length(h) > 3)), 1, 20)


def summarize_text(c: Column | str) -> Column:
    """The first line longer than ten characters, cut at 120; else the number of lines."""
    body = lines(F.trim(text(c)))
    hit = first(F.filter(trimmed(body), lambda x: F.length(x) > 10))
    return F.when(hit != "", F.left(hit, F.lit(120))).otherwise(F.concat(F.size(body).cast("string"), F.lit(" lines")))


def summarize_markdown(c: Column | str) -> Column:
    """The first heading and the first body line, cut at 100."""
    body = lines(F.trim(text(c)))
    heading = F.trim(F.regexp_replace(first(F.filter(body, lambda x: x.startswith("#"))), "^#+", ""))
    plain = F.left(first(F.filter(trimmed(body), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("---"))), F.lit(100))
    return F.when((heading != "") & (plain != ""), F.concat(heading, F.lit(": "), plain)).when(heading != "", heading).when(plain != "", plain).otherwise("Empty markdown")


def summarize_jsonl(c: Column | str) -> Column:
    """Number of entries and the first five fields of the first one."""
    body = lines(F.trim(text(c)))
    keys = F.json_object_keys(F.element_at(body, 1))
    n = F.size(body).cast("string")
    return F.when(keys.isNotNull(), F.concat(n, F.lit(" entries, fields: "), F.array_join(F.slice(keys, 1, 5), ", "))).otherwise(F.concat(n, F.lit(" lines (JSONL)")))


def summarize_json(c: Column | str) -> Column:
    """The kind of a JSON value, with its first five keys or its number of items."""
    body = text(c)
    value = F.try_parse_json(body)
    kind = F.schema_of_variant(value)
    keys, items = F.json_object_keys(body), F.json_array_length(body)
    return (
        F.when(value.isNull(), "Invalid JSON")
        .when(keys.isNotNull(), F.concat(F.lit("JSON object with keys: "), F.array_join(F.slice(keys, 1, 5), ", ")))
        .when(items.isNotNull(), F.concat(F.lit("JSON array with "), items.cast("string"), F.lit(" items")))
        .when(kind == "STRING", "JSON value: str")
        .when(kind == "BOOLEAN", "JSON value: bool")
        .when(kind == "VOID", "JSON value: NoneType")
        .when(kind == "BIGINT", "JSON value: int")
        .otherwise("JSON value: float")
    )


def summarize(c: Column | str, path: Column | str) -> Column:
    """A summary by the path's suffix."""
    name = F.lower(text(path))
    return F.when(name.endswith(".jsonl"), summarize_jsonl(c)).when(name.endswith(".md"), summarize_markdown(c)).when(name.endswith(".json"), summarize_json(c)).otherwise(summarize_text(c))


def ingest_summary(c: Column | str, path: Column | str) -> Column:
    """File name, first heading and first line of prose, the latter cut at 200 characters."""
    body = trimmed(lines(text(c)))
    name = F.element_at(F.split(text(path), "/"), -1)
    heading = F.trim(F.regexp_replace(first(F.filter(body, lambda x: x.startswith("#"))), "^#+", ""))
    line = first(F.filter(body, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("---") & ~x.startswith("|")))
    line = F.when(F.length(line) > 200, F.concat(F.left(line, F.lit(200)), F.lit("..."))).otherwise(line)
    return F.when(heading != "", F.concat(name, F.lit(": "), heading, F.lit(". "), line)).otherwise(F.concat(name, F.lit(": "), line))


def sanitize_summary(c: Column | str) -> Column:
    """The first 200 characters without lines that look like instructions, on one line."""
    bad = lambda x: F.exists(literal_array(lexicon.INJECTIONS), lambda p: F.contains(F.lower(x), p))
    return F.trim(F.array_join(F.filter(lines(F.left(text(c), F.lit(200))), lambda x: ~bad(x)), " "))


def sanitize_query(c: Column | str) -> Column:
    """The first 50 characters without markup and line ends."""
    return F.regexp_replace(F.left(text(c), F.lit(50)), r"[\n\r#*`\[\]<>]", "")


def contextualize(summary: Column | str, content: Column | str) -> Column:
    """A summary and the first 500 characters of what it sums up."""
    return F.concat(text(summary), F.lit("\n\n"), F.left(text(content), F.lit(500)))


def shingles(c: Column | str, n: int = 4) -> Column:
    """All windows of ``n`` characters of the lower-cased text; a shorter text is one window."""
    low = F.lower(text(c))
    windows = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.concat(*(F.get(a, i + k) for k in range(n))))
    return F.when(F.length(low) < n, F.array(low)).otherwise(let(F.filter(F.split(low, ""), lambda x: x != ""), windows))


def expand_query(c: Column | str) -> Column:
    """Each token with synonyms becomes a group of alternatives, phrases quoted."""
    groups = {t: "(" + " OR ".join(f'"{s}"' if " " in s else s for s in g) + ")" for t, g in lexicon.synonyms().items()}
    table = F.map_from_arrays(literal_array(list(groups)), literal_array(list(groups.values())))
    return F.array_join(F.transform(F.filter(F.split(text(c), r"\s+"), lambda t: t != ""), lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), t)), " ")


def context_line(tier: Column, path: Column, chars: Column, age_days: Column, summary: Column) -> Column:
    """One line of a context listing."""
    icons = F.create_map(*map(F.lit, ("hot", "●", "warm", "◐", "cold", "○", "frozen", "◌")))
    return F.concat(F.coalesce(F.try_element_at(icons, tier), F.lit("?")), F.lit(" ["), tier, F.lit("] "), path, F.lit(" ("), chars.cast("string"), F.lit(" chars, "), F.round(age_days, 0).cast("long").cast("string"), F.lit("d old) — "), summary)


def recall_hint(tier: Column) -> Column:
    """What recall from a tier takes."""
    hints = {
        "hot": "instant access",
        "warm": "quick recall (~10ms, light decompression)",
        "cold": "slower recall (~500ms, dictionary decompression, may need encryption key)",
        "frozen": "slowest recall (~5-10s, Parquet restoration, may need encryption key)",
    }
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, [x for kv in hints.items() for x in kv])), tier), F.lit("unknown tier"))


def context_block(tier: Column, line: Column, keywords: Column) -> Column:
    """A context line with, where they apply, the recall hint and the first ten keywords below it."""
    hint = F.when(tier.isin("cold", "frozen"), F.concat(F.lit("  ⏱ Recall: "), recall_hint(tier)))
    words = F.when(F.size(keywords) > 0, F.concat(F.lit("  Keywords: "), F.array_join(F.slice(keywords, 1, 10), ", ")))
    return F.concat_ws("\n", line, hint, words)


def format_size(c: Column | str) -> Column:
    n = F.col(c) if isinstance(c, str) else c
    unit = lambda power, name: F.concat(F.format_string("%.1f", F.bround(n / 1024.0**power, 1)), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def minify_json(c: Column | str) -> Column:
    """Each line that is JSON in compact form, others stripped, blank ones gone."""
    slim = F.transform(lines(text(c)), lambda x: F.coalesce(F.to_json(F.try_parse_json(x)), F.trim(x)))
    return F.array_join(F.filter(slim, lambda x: x != ""), "\n")


def looks_like_jsonl(c: Column | str) -> Column:
    """Whether two or more of the first five lines start with a brace."""
    return F.size(F.filter(F.slice(lines(F.trim(text(c))), 1, 5), lambda x: F.trim(x).startswith("{"))) >= 2


def is_boilerplate(c: Column | str, least: int = 500) -> Column:
    body = text(c)
    hit = F.lit(False)
    for m in lexicon.BOILERPLATE:
        hit |= F.contains(body, F.lit(m))
    return hit & (F.length(body) >= least)


def section(c: Column | str, name: str) -> Column:
    """The body of the Markdown section of this heading, up to the next heading."""
    return F.regexp_extract(text(c), rf"(?ms)^#{{1,3}}\s+{name}\s*?$\s*(.*?)\s*(?=^#{{1,3}}\s|\z)", 1)
