"""Cleaning, risk scanning, masking and identification of documents.

Everything is a JVM expression but Unicode NFKC, which has no built-in and runs as one
Arrow UDF per batch.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.functions import rules as ru

# Fixed value: the URL/DNS-style namespace of the chunk identifiers.
POINT_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def let(value: Column, use) -> Column:
    """Bind an expression once and use it several times (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def tidy(text: Column) -> Column:
    """Everything of the normal form but NFKC: invisible characters, line ends, blanks, trim."""
    t = F.regexp_replace(text, ru.INVISIBLE, "")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, ru.LONG_BLANKS, " ")
    t = F.regexp_replace(t, ru.MANY_NEWLINES, "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def normalise(df: DataFrame, text: str = "text") -> DataFrame:
    """Canonical text, before any check; the order of steps is part of the meaning."""
    return df.withColumn(text, nfkc(F.col(text))).withColumn(text, tidy(F.col(text)))


def folded(text: Column) -> Column:
    """Lower case as the rules' patterns ignore case: a sign that they take for a letter becomes that letter."""
    return F.lower(F.replace(F.upper(text), F.lit("\u0130"), F.lit("I")))  # Spark would shorten lower(upper(text)) to lower(text)


def _hinted(low: Column, name: str) -> Column:
    """Whether a folded text may match a rule: a search for words costs a fraction of one for a pattern."""
    out = F.lit(False)
    for words in ru.INJECTION_HINTS[name]:
        every = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            every = every & F.contains(low, F.lit(w))
        out = out | every
    return out


def injection_report(text: Column, among: Column | None = None) -> Column:
    """struct(score, rules, sample, risk) of a normalised text; ``among``: the only rules that can match, if that is known."""
    able = lambda name: F.lit(True) if among is None else F.array_contains(among, name)

    def found(low: Column) -> Column:
        hits = [
            F.when(
                able("hidden_html_comment") & F.contains(text, F.lit("<!--")) & F.regexp_like(text, F.lit(ru.HTML_COMMENT)),
                F.struct(F.lit("hidden_html_comment").alias("rule"), F.lit(ru.HIDDEN_COMMENT_WEIGHT).alias("w"),
                         F.substring(F.regexp_extract(text, ru.HTML_COMMENT, 0), 1, 160).alias("sample")),
            )
        ]
        for name, weight, pattern in ru.INJECTION_RULES:
            p = f"(?iU){pattern}"
            hint = _hinted(low, name) if name in ru.INJECTION_HINTS else F.lit(True)
            hits.append(
                F.when(
                    able(name) & hint & F.regexp_like(text, F.lit(p)),
                    F.struct(F.lit(name).alias("rule"), F.lit(weight).alias("w"),
                             F.substring(F.regexp_extract(text, p, 0), 1, 160).alias("sample")),
                )
            )
        return F.array_compact(F.array(*hits))

    def report(h: Column) -> Column:
        score = F.aggregate(h, F.lit(0), lambda a, x: a + x["w"])
        return F.struct(
            score.alias("score"),
            F.transform(h, lambda x: x["rule"]).alias("rules"),
            F.coalesce(F.try_element_at(h, F.lit(1))["sample"], F.lit("")).alias("sample"),
            F.when(score >= ru.RISK_HIGH, 2).when(score >= ru.RISK_MEDIUM, 1).otherwise(0).alias("risk"),
        )

    low = folded(text) if among is None else F.when(F.size(among) > 0, folded(text)).otherwise(F.lit(""))
    return let(let(low, found), report)


def chunk_risk(chunk: Column, doc: Column, trusted: Column) -> Column:
    """A chunk inherits the risk of its document when the source is not trusted."""
    return F.greatest(chunk, F.when(trusted, F.lit(0)).otherwise(doc))


def triage_question(text: Column) -> Column:
    """struct(verdict, reason, patterns, question): clean, suspicious or rejected by length."""
    def judge(q: Column) -> Column:
        size_bad = ~F.length(q).between(ru.QUESTION_MIN, ru.QUESTION_MAX)

        def with_neutral(n: Column) -> Column:
            hits = F.array_compact(
                F.array(*[F.when(F.regexp_like(n, F.lit(f"(?iU){p}")), F.lit(i)) for i, p in enumerate(ru.QUESTION_PATTERNS)])
            )
            tags = n != q
            return F.struct(
                F.when(size_bad, "rejected").when(tags | (F.size(hits) > 0), "suspicious").otherwise("clean").alias("verdict"),
                F.when(size_bad, "length").when(tags, "tags").when(F.size(hits) > 0, "pattern").otherwise("").alias("reason"),
                F.when(size_bad, F.array().cast("array<int>")).otherwise(hits).alias("patterns"),
                F.when(size_bad, F.substring(q, 1, ru.QUESTION_MAX)).otherwise(n).alias("question"),
            )

        return let(F.regexp_replace(q, ru.SERVICE_TAG, ""), with_neutral)

    return let(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), judge)


def neutralise_urls(text: Column) -> Column:
    """[link: http(:)//host/path] without query and fragment."""
    return F.regexp_replace(text, r"(?i)(https?)://([^\s<>\"'\)\]?#]*)([?#][^\s<>\"'\)\]]*)?", r"[ссылка: $1(:)//$2]")


def strip_untrusted(text: Column, strip_urls: bool) -> Column:
    """struct(text, removed): hidden blocks, tags and markdown links of untrusted content."""
    steps = [
        ("html_comments", ru.HTML_COMMENT, " "),
        ("html_tags", ru.HTML_TAG, " "),
        ("md_links", ru.MD_LINK, "$1 ($2)"),
    ]
    state = F.struct(text.alias("t"), F.array().cast("array<string>").alias("removed"))
    for name, pattern, repl in steps:

        def step(s: Column, name=name, pattern=pattern, repl=repl) -> Column:
            return F.struct(
                F.regexp_replace(s["t"], pattern, repl).alias("t"),
                F.when(F.regexp_like(s["t"], F.lit(pattern)), F.concat(s["removed"], F.array(F.lit(name))))
                .otherwise(s["removed"]).alias("removed"),
            )

        state = let(state, step)
    if strip_urls:
        state = let(state, lambda s: F.struct(
            neutralise_urls(s["t"]).alias("t"), F.concat(s["removed"], F.array(F.lit("urls_neutralized"))).alias("removed")))
    return state


def _replace_each(text: Column, pattern: str, new) -> Column:
    """struct(t, n): every match m replaced by new(m); n counts matches that changed."""
    def go(p: Column) -> Column:
        # there is one more part than there are matches
        parts = F.split(text, pattern, -1)
        masked = F.transform(p["found"], lambda m: F.struct(m.alias("old"), new(m).alias("new")))
        return F.struct(
            F.when(F.size(p["found"]) > 0, F.array_join(
                F.zip_with(parts, masked, lambda a, m: F.concat(a, F.coalesce(m["new"], F.lit("")))), ""
            )).otherwise(text).alias("t"),
            F.size(F.filter(masked, lambda m: m["old"] != m["new"])).alias("n"),
        )

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), go)


def _mask(entity: str, pseudonymise: bool):
    def new(m: Column) -> Column:
        label = (
            F.concat(F.lit(f"[{entity}:"), F.substring(F.sha2(m, 256), 1, 8), F.lit("]"))
            if pseudonymise
            else F.lit(f"[{entity}]")
        )
        if entity == "CARD":
            return F.when(luhn_ok(m), label).otherwise(m)
        if entity == "IP":
            return F.when(F.regexp_like(m, F.lit(ru.PRIVATE_IP)), m).otherwise(label)
        if entity == "INN":
            return F.when((F.length(m) == 10) & F.startswith(m, F.lit("0")), m).otherwise(label)
        return label

    return new


def mask_pii(text: Column, pseudonymise: bool = True, only: tuple[str, ...] = ()) -> Column:
    """struct(t, counts): personal data replaced type by type, counts in the order of the rules.

    A text without an at sign is not searched for addresses, nor one without ``PII_DIGITS`` for the types that hold digits: as long as
    none of them matches, the text stays as it is.
    """
    def masked(state: Column, rules) -> Column:
        for entity, pattern in rules:

            def step(s: Column, entity=entity, pattern=pattern) -> Column:
                return let(
                    F.struct(_replace_each(s["t"], pattern, _mask(entity, pseudonymise)).alias("r"), s["counts"].alias("c")),
                    lambda x: F.struct(x["r"]["t"].alias("t"), F.concat(x["c"], F.array(x["r"]["n"])).alias("counts")),
                )

            state = let(state, step)
        return state

    state = F.struct(text.alias("t"), F.array().cast("array<int>").alias("counts"))
    wanted = [r for r in ru.PII_PATTERNS if not only or r[0] in only]
    for rules, may in (
        ([r for r in wanted if r[0] == "EMAIL"], lambda t: F.contains(t, F.lit("@"))),
        ([r for r in wanted if r[0] != "EMAIL"], lambda t: F.regexp_like(t, F.lit(ru.PII_DIGITS))),
    ):
        if rules:
            none = F.array(*[F.lit(0)] * len(rules))

            def part(s: Column, rules=rules, may=may, none=none) -> Column:
                as_it_is = F.struct(s["t"].alias("t"), F.concat(s["counts"], none).alias("counts"))
                return F.when(may(s["t"]) | s["t"].isNull(), masked(s, rules)).otherwise(as_it_is)

            state = let(state, part)
    return state


def redact_secrets(text: Column) -> Column:
    """struct(t, counts) for the secret kinds."""
    state = F.struct(text.alias("t"), F.array().cast("array<int>").alias("counts"))
    for name, pattern in ru.SECRET_PATTERNS:

        def step(s: Column, name=name, pattern=pattern) -> Column:
            return F.struct(
                F.regexp_replace(s["t"], pattern, f"[SECRET:{name}]").alias("t"),
                F.concat(s["counts"], F.array(F.regexp_count(s["t"], F.lit(pattern)))).alias("counts"),
            )

        state = let(state, step)
    return state


def scrub_for_logs(text: Column, limit: int = 400) -> Column:
    """Mask, redact, one line, at most ``limit`` characters and an ellipsis."""
    clean = F.regexp_replace(redact_secrets(mask_pii(text)["t"])["t"], "\n", " ")
    return let(clean, lambda c: F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c))


def luhn_ok(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def snils_ok(value: Column) -> Column:
    """Weighted checksum modulo 101 of an 11-digit pension number; low reserved numbers fail."""
    def check(d: Column) -> Column:
        body = F.substring(d, 1, 9)
        total = F.aggregate(
            F.sequence(F.lit(1), F.lit(9)), F.lit(0),
            lambda a, i: a + F.substr(d, i, F.lit(1)).cast("int") * (F.lit(10) - i),
        )
        rest = total % 101
        want = F.when(rest == 100, 0).otherwise(rest)
        return (F.length(d) == 11) & (F.try_to_number(body, F.lit("999999999")) > 1001998) & (want == F.substring(d, 10, 2).cast("int"))

    d = F.regexp_replace(value, r"\D", "")
    return F.coalesce(let(F.when(F.length(d) == 11, d), check), F.lit(False))


def uuid5(key: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Name-based identifier, equal to the standard library's uuid5."""
    def fmt(h: Column) -> Column:
        variant = F.element_at(
            F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1
        )
        return F.concat(
            F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
            variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
        )

    return let(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "UTF-8"))), fmt)


def checksum(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def fingerprint(text: Column) -> Column:
    """Length and hash instead of the text itself."""
    return F.struct(
        F.length(text).alias("question_len"),
        F.substring(F.sha2(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), 256), 1, 12).alias("question_hash"),
    )


def iso_to_unix(s: Column) -> Column:
    """Seconds since the epoch in UTC; 0 for what is no date."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(s)), F.lit(0))


def is_refusal(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for marker in ru.REFUSAL_MARKERS:
        out = out | F.contains(low, F.lit(marker))
    return out


def urls(text: Column) -> Column:
    """Distinct URLs without trailing punctuation."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(ru.URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,);]+$", ""))
    )


def answer_problems(answer: Column, context: Column, allowed: Column, canary: Column, need_citation: Column) -> Column:
    """Problem codes of an answer: leak, unknown URLs, bad or missing citations, secrets."""
    unknown = F.size(F.array_except(urls(answer), urls(context)))
    cited = F.transform(F.regexp_extract_all(answer, F.lit(r"\[#(\d+)\]"), F.lit(1)), lambda c: c.cast("bigint"))

    def codes(c: Column) -> Column:
        bad = F.sort_array(F.array_except(c, allowed))
        return F.array_compact(
            F.array(
                F.when(F.contains(answer, canary), F.lit("system_prompt_leak")),
                F.when(unknown > 0, F.concat(F.lit("unknown_urls:"), unknown)),
                F.when(F.size(bad) > 0, F.concat(F.lit("invalid_citations:"), F.array_join(bad, ","))),
                F.when(need_citation & (F.size(c) == 0), F.lit("no_citation")),
                F.when(F.exists(redact_secrets(answer)["counts"], lambda n: n > 0), F.lit("secret_in_answer")),
            )
        )

    return let(cited, codes)
