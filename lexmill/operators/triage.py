"""Checks of structured answers: schema, grounding, business rules, rubrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.evaluation import violations
from lexmill.operators.hygiene import let

# Enumerations and rule patterns.
CATEGORIES = ("outage", "billing", "access", "performance", "question", "other")
PRIORITIES = ("low", "normal", "high", "critical")
CONCRETE = (
    r"(?iU)\d|\.(ru|com|io|net|org|рф|php|html|js)\b|сервер|сайт|домен|баз[аы]|бэкап|счёт|счет|api|ssl|"
    r"почт|dns|диск|ftp|mysql|панел|логин|парол|shell|файл|ошибк|error|denied|gateway|timeout"
)
REFUND = r"(?iU)дважды|двойн|верн[иу]|возврат|лишнее списание"
FIELDS = ("category", "priority", "facts", "needs_human", "summary")


def json_object(text: Column) -> Column:
    """The widest {...} of a text, empty when there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def json_type(doc: Column, path: str) -> Column:
    """Type name of a JSON member: null, bool, number, string, array, object; missing -> null value."""
    kind = F.schema_of_variant(F.variant_get(doc, path, "variant"))
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "bool").when(kind == "STRING", "string")
        .when(F.startswith(kind, F.lit("ARRAY")), "array").when(F.startswith(kind, F.lit("OBJECT")), "object")
        .when(kind.isNotNull(), "number")
    )


def parse_triage(raw: Column) -> Column:
    """struct(ok, reason, category, priority, facts, needs_human, summary)."""
    schema = "category string, priority string, facts array<string>, needs_human boolean, summary string"

    def go(x: Column) -> Column:
        j, v = x["j"], x["v"]
        t = x["t"]
        keys = F.array_sort(F.json_object_keys(j))
        size = F.length(F.trim(t["summary"]))
        bad = violations(
            keys=~keys.eqNullSafe(F.array(*[F.lit(f) for f in sorted(FIELDS)])),
            category=~F.coalesce(t["category"].isin(*CATEGORIES), F.lit(False)),
            priority=~F.coalesce(t["priority"].isin(*PRIORITIES), F.lit(False)),
            facts=~F.coalesce(F.size(t["facts"]).between(1, 5), F.lit(False)),
            needs_human=~F.coalesce(json_type(v, "$.needs_human") == "bool", F.lit(False)),
            summary=~F.coalesce(size.between(5, 200), F.lit(False)),
        )
        reason = F.when(j == "", "no_object").when(v.isNull(), "not_json").otherwise(bad)
        return F.struct(
            (reason == "").alias("ok"), reason.alias("reason"), t["category"].alias("category"), t["priority"].alias("priority"),
            t["facts"].alias("facts"), t["needs_human"].alias("needs_human"), t["summary"].alias("summary"),
        )

    j = json_object(raw)
    return let(j, lambda j: go_struct(j, schema, go))


def go_struct(j: Column, schema: str, go) -> Column:
    return let(
        F.struct(j.alias("j"), F.try_parse_json(j).alias("v"), F.from_json(j, schema).alias("t")), go
    )


def normalise_quote(t: Column) -> Column:
    """Case, yo, quotes, dashes and blanks do not count."""
    s = F.translate(F.lower(t), "ё–—«»\"'“”„`", "е--")
    return F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[ .,;:!?-]+|[ .,;:!?-]+$", "")


def grounded(fact: Column, text: Column) -> Column:
    return let(normalise_quote(fact), lambda f: (F.length(f) >= 4) & F.contains(normalise_quote(text), f))


def policy(category: Column, priority: Column, facts: Column, needs_human: Column, text: Column) -> Column:
    """Broken business rules R1..R7, joined by commas."""
    urgent = priority.isin("high", "critical")
    concrete = F.exists(facts, lambda f: F.regexp_like(f, F.lit(CONCRETE)))
    return violations(
        R1=(category == "outage") & ~urgent,
        R2=(priority == "critical") & ~category.isin("outage", "access"),
        R3=urgent & ~concrete,
        R4=(category == "billing") & F.regexp_like(text, F.lit(REFUND)) & ~needs_human,
        R5=(category == "question") & (urgent | needs_human),
        R6=((category == "outage") | urgent) & ~needs_human,
        R7=(category == "billing") & urgent,
    )


def fact_list(raw: Column, limit: int = 4) -> Column:
    """Non-empty strings of the first [...] of a text, at most ``limit``; [] when it is no JSON."""
    found = F.regexp_extract(raw, r"(?s)\[.*\]", 0)

    def strings(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))

    kept = F.filter(
        strings(F.try_parse_json(found)),
        lambda x: (F.schema_of_variant(x) == "STRING") & (F.trim(F.try_variant_get(x, "$", "string")) != ""),
    )
    return F.slice(F.transform(kept, lambda x: F.try_variant_get(x, "$", "string")), 1, limit)


def rubric(text: Column, kind: Column) -> Column:
    """struct(score, fails): 0-5 points for a strict {"answer", "confidence"} object."""
    body = F.trim(text)

    def go(x: Column) -> Column:
        v, j = x["v"], x["j"]
        obj = F.startswith(j, F.lit("{")) & F.endswith(j, F.lit("}"))
        keys = F.when(obj, F.array_sort(F.json_object_keys(j)))
        exact = F.coalesce(keys == F.array(F.lit("answer"), F.lit("confidence")), F.lit(False))
        at = F.when(obj, F.coalesce(json_type(v, "$.answer"), F.lit("null"))).otherwise("null")
        ct = F.when(obj, json_type(v, "$.confidence"))
        conf = F.when(ct == "number", F.try_variant_get(v, "$.confidence", "double"))
        answer = F.when(at == "string", F.try_variant_get(v, "$.answer", "string"))
        types = at.isin("null", "string") & F.coalesce(conf.between(0.0, 1.0), F.lit(False))
        sense = (
            F.when(kind == "off_topic", (at == "null") & (conf <= 0.2))
            .when(kind == "on_topic", (at == "string") & (F.trim(answer) != "") & (conf >= 0.5))
            .when(kind == "partial", (at == "string") & conf.between(0.4, 0.8))
            .when(kind == "vague", (at == "string") & (conf <= 0.5))
        )
        good = F.coalesce(sense, F.lit(False))
        score = 1 + obj.cast("int") + exact.cast("int") + types.cast("int") + (types & good).cast("int")
        fails = violations(prose=~obj, keys=~exact, types=~types, meaning=types & ~good)
        return F.struct(
            F.when(v.isNull(), 0).otherwise(score).alias("score"), F.when(v.isNull(), "not_json").otherwise(fails).alias("fails")
        )

    return let(F.struct(body.alias("j"), F.try_parse_json(body).alias("v")), go)


def _exact(answer: Column, expected: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(answer), r"""^[.!«»"']+|[.!«»"']+$""", "")) == F.lower(expected)


def _contains_all(answer: Column, expected: Column) -> Column:
    return F.forall(F.from_json(expected, "array<string>"), lambda p: F.contains(F.lower(answer), F.lower(p)))


def _regex(answer: Column, expected: Column) -> Column:
    return F.regexp_like(F.trim(answer), F.concat(F.lit("(?m)"), expected))


def _json_keys(answer: Column, expected: Column) -> Column:
    j = json_object(answer)
    ok = F.try_parse_json(j).isNotNull() & (j != "")
    keys = F.when(ok, F.json_object_keys(j))
    return F.coalesce(F.size(F.array_except(F.from_json(expected, "array<string>"), keys)) == 0, F.lit(False))


# Checkers by name: (answer, expected) -> boolean column.
CHECKERS = {"exact": _exact, "contains_all": _contains_all, "regex": _regex, "json_keys": _json_keys}


def check(name: Column, answer: Column, expected: Column) -> Column:
    """The checker named in the row; an unknown name fails."""
    out = F.lit(False)
    for key, fn in CHECKERS.items():
        out = F.when(name == key, F.coalesce(fn(answer, expected), F.lit(False))).otherwise(out)
    return out


def label_of(answer: Column) -> Column:
    """After the last colon, lower case, without surrounding punctuation."""
    tail = F.element_at(F.split(answer, ":"), -1)
    return F.regexp_replace(F.lower(F.trim(tail)), r"""^[.,!«»"' ]+|[.,!«»"' ]+$""", "")


def last_number(text: Column) -> Column:
    """The last number of a text, decimal comma allowed."""
    hits = F.regexp_extract_all(text, F.lit(r"-?\d+(?:[.,]\d+)?"), F.lit(0))
    return F.replace(F.try_element_at(hits, F.lit(-1)), F.lit(","), F.lit(".")).try_cast("double")


def mode_summary(rows: DataFrame) -> DataFrame:
    """One row per mode: shares of passed checks, accuracies, quality, cost."""
    def share(c: str) -> Column:
        return F.avg(F.col(c).cast("double"))

    names = ("accepted", "schema_ok", "grounded_ok", "rules_ok", "category_ok", "priority_ok", "within_one", "human_ok")
    s = rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"), *[share(c).alias(c) for c in names],
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"),
    )
    return s.withColumn("quality", (F.col("category_ok") + F.col("priority_ok") + F.col("human_ok")) / 3)
