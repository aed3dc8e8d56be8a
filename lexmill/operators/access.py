"""Row-level security and metadata filters as Column predicates and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Risk order and the demonstration principals (user, tenant, departments, clearance).
RISK_ORDER = {"low": 0, "medium": 1, "high": 2}
PRINCIPALS = (
    ("u-1001", "employee", "main", ["all"], 0),
    ("u-2002", "engineer", "main", ["all", "eng"], 1),
    ("u-3003", "hr", "main", ["all", "hr"], 2),
    ("u-9009", "other_tenant", "acme", ["all", "eng"], 2),
    ("anonymous", "anonymous", "main", [], 0),
)
PRINCIPAL_SCHEMA = "user_id string, role string, tenant_id string, departments array<string>, clearance int"


def principals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRINCIPALS), PRINCIPAL_SCHEMA)


def can_read() -> Column:
    """Tenant, department and clearance; expects document and principal columns side by side."""
    return (
        (F.coalesce("doc_tenant", "tenant_id") == F.col("tenant_id"))
        & ((F.col("department") == "all") | F.array_contains("departments", F.col("department")))
        & (F.col("sensitivity") <= F.col("clearance"))
    )


def pre_filter(
    only_current: bool = True, allow_untrusted: bool = True, max_risk: str = "medium", extra: tuple[Column, ...] = ()
) -> Column:
    """The whole filter that belongs before ranking."""
    cond = can_read() & (F.col("risk_level") <= RISK_ORDER.get(max_risk, 1))
    if only_current:
        cond = cond & F.col("is_current")
    if not allow_untrusted:
        cond = cond & (F.col("source_type") == "trusted")
    for more in extra:
        cond = cond & more
    return cond


def visible(docs: DataFrame, who: DataFrame, cond: Column) -> DataFrame:
    """Documents with the principals who may see them.

    The tenant is an equality, so this is an equi-join; the rest filters its output. A row
    without a tenant takes the tenant of whoever asks and is matched to every tenant.
    """
    tenants = who.agg(F.collect_set("tenant_id").alias("t")).scalar()
    owner = F.when(F.col("doc_tenant").isNull(), tenants).otherwise(F.array("doc_tenant"))
    pairs = docs.withColumn("_t", F.explode(owner))
    return pairs.join(who, pairs["_t"] == who["tenant_id"]).drop("_t").where(cond)


def describe(only_current: bool = True, max_risk: str = "medium") -> Column:
    """The filter of a principal in readable form."""
    depts = F.array_distinct(F.concat(F.array(F.lit("all")), F.col("departments")))
    parts = [
        F.concat(F.lit("tenant_id = "), F.col("tenant_id")),
        F.concat(F.lit("sensitivity <= "), F.col("clearance")),
        F.concat(F.lit("department in ["), F.array_join(depts, ", "), F.lit("]")),
        F.lit(f"risk_level <= {RISK_ORDER[max_risk]}"),
    ]
    if only_current:
        parts.append(F.lit("is_current = true"))
    return F.concat_ws(" AND ", *parts)


_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(*v),
    "$nin": lambda c, v: ~c.isin(*v),
}


def where(spec: dict) -> Column:
    """A metadata filter given as a dict: field comparisons, $and / $or, must / should / must_not."""
    terms: list[Column] = []
    for key, value in spec.items():
        if key in ("$and", "must"):
            terms += [where(v) for v in value]
        elif key in ("$or", "should"):
            any_of = where(value[0])
            for v in value[1:]:
                any_of = any_of | where(v)
            terms.append(any_of)
        elif key == "must_not":
            terms += [~where(v) for v in value]
        elif isinstance(value, dict):
            terms += [_COMPARE[op](F.col(key), arg) for op, arg in value.items()]
        else:
            terms.append(F.col(key) == value)
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def access_matrix(docs: DataFrame, who: DataFrame, roles: list[str], id_col: str = "doc_id") -> DataFrame:
    """One row per document, one boolean column per role."""
    seen = visible(docs, who, can_read()).select(id_col, "role")
    wide = seen.groupBy(id_col).pivot("role", roles).agg(F.count(F.lit(1)))
    out = docs.select(id_col).join(wide, id_col, "left")
    return out.select(id_col, *[(F.coalesce(F.col(r), F.lit(0)) > 0).alias(r) for r in roles])


def set_difference(found: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Per role: rows found but not allowed and allowed but not found; equal when both are 0."""
    a, b = found.select(*keys).distinct(), allowed.select(*keys).distinct()
    sides = a.exceptAll(b).withColumn("side", F.lit(1)).unionByName(b.exceptAll(a).withColumn("side", F.lit(-1)))
    sizes = a.groupBy("role").agg(F.count(F.lit(1)).alias("n_found"))
    diff = sides.groupBy("role").agg(
        F.count_if(F.col("side") == 1).alias("extra"), F.count_if(F.col("side") == -1).alias("missing")
    )
    zero = {"n_found": 0, "extra": 0, "missing": 0}
    out = sizes.join(diff, "role", "full_outer").fillna(zero)
    return out.withColumn("equal", (F.col("extra") == 0) & (F.col("missing") == 0))
