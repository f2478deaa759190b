"""Dataset governance: duplicate and leakage audits of a manifest, transitive duplicate groups, leak-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.fingerprint import canonical_fingerprint
from brindle.sources.storage import checkpointed

IDS = 10
# The fields whose groups must not cross splits, and how grave a crossing is.
LEAKS = (("package", "package-split-overlap", "error"), ("group_id", "group-split-overlap", "error"), ("representation_hash", "representation-split-overlap", "error"), ("family", "family-split-overlap", "warning"), ("campaign", "campaign-split-overlap", "warning"))


def package_key(ecosystem: Column, package: Column) -> Column:
    """Package identity: lower case, and for Python packages runs of -, _ and . as one hyphen."""
    name = F.lower(F.trim(package))
    python = F.lower(ecosystem).isin("pypi", "python")
    return F.concat(F.lower(ecosystem), F.lit(":"), F.when(python, F.regexp_replace(name, "[-_.]+", "-")).otherwise(name))


def _with_ids(found: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """found with sample_ids, the first IDS sample ids of its keys in rows.

    Ranks are cut to IDS before they are shuffled, and no array holds more, however many rows a key has.
    """
    own = rows.join(found.select(*keys), keys, "left_semi").select(*keys, "sample_id").distinct()
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("sample_id"))).filter(F.col("_r") <= IDS)
    return found.join(first.groupBy(*keys).agg(F.array_sort(F.collect_list("sample_id")).alias("sample_ids")), keys, "left")


def duplicate_issues(rows: DataFrame) -> DataFrame:
    """One finding per digest that several rows have."""
    g = rows.groupBy("sha256").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.count_distinct("split").alias("splits")).filter("n > 1 and sha256 is not null")
    conflict = F.col("labels") > 1
    return _with_ids(g, rows, ["sha256"]).select(
        F.when(conflict | (F.col("splits") > 1), "error").otherwise("warning").alias("severity"), F.when(conflict, "conflicting-label-duplicate").otherwise("exact-duplicate").alias("code"), F.col("sha256").alias("value"), F.col("n"), "sample_ids",
    )


def repeated_ids(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("sample_id").agg(F.count("*").alias("n")).filter("n > 1")
    return g.select(F.lit("error").alias("severity"), F.lit("duplicate-sample-id").alias("code"), F.col("sample_id").alias("value"), "n", F.array("sample_id").alias("sample_ids"))


def leak_issues(rows: DataFrame) -> DataFrame:
    """Fields whose value occurs in several splits; null values are skipped and null splits ignored. One pass for all fields."""
    value = {"package": package_key(F.col("ecosystem"), F.col("package"))}
    fields = [F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), value.get(f, F.col(f)).alias("value")) for f, code, severity in LEAKS]
    long = rows.select("sample_id", "split", F.explode(F.array(*fields)).alias("f")).select("sample_id", "split", "f.*").filter("value is not null")
    g = long.groupBy("severity", "code", "value").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    return _with_ids(g.filter("splits > 1").drop("splits"), long, ["severity", "code", "value"])


def fragmented_packages(rows: DataFrame) -> DataFrame:
    """Packages that use several group ids."""
    named = rows.select("sample_id", "group_id", package_key(F.col("ecosystem"), F.col("package")).alias("value"))
    g = named.groupBy("value").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups")).filter("groups > 1")
    return _with_ids(g, named, ["value"]).select(F.lit("warning").alias("severity"), F.lit("package-group-fragmentation").alias("code"), "value", "n", "sample_ids")


def temporal_issues(rows: DataFrame) -> DataFrame:
    """Pairs of splits of which the earlier one does not end before the later one begins."""
    t = rows.filter("split is not null").groupBy("split").agg(F.max("first_seen").alias("last"), F.min("first_seen").alias("first"), F.count("*").alias("n"))
    order = F.create_map(*[F.lit(x) for kv in (("train", 0), ("validation", 1), ("test", 2)) for x in kv])
    a, b = t.select(F.col("split").alias("a"), "last", F.col("n").alias("an")), t.select(F.col("split").alias("b"), "first", F.col("n").alias("bn"))
    j = a.crossJoin(F.broadcast(b)).filter((order[F.col("a")] < order[F.col("b")]) & (F.col("last") >= F.col("first")))  # three rows a side
    return j.select(F.lit("warning").alias("severity"), F.lit("temporal-order").alias("code"), F.concat_ws(">", "a", "b").alias("value"), (F.col("an") + F.col("bn")).alias("n"), F.array().cast("array<string>").alias("sample_ids"))


def issues(rows: DataFrame) -> DataFrame:
    parts = [repeated_ids(rows), duplicate_issues(rows), leak_issues(rows), fragmented_packages(rows), temporal_issues(rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit(rows: DataFrame, max_issues: int = 100) -> DataFrame:
    """One row: the rows' published fingerprint, counts by severity, label, split and ecosystem, and the first issues.

    Counts are taken before any issues are left out.
    """
    found = issues(rows)
    counts = found.agg(F.count_if(F.expr("severity = 'error'")).alias("errors"), F.count_if(F.expr("severity = 'warning'")).alias("warnings"), F.count("*").alias("n_issues"))
    first = found.orderBy("severity", "code", "value").limit(max_issues).agg(F.sort_array(F.collect_list(F.struct("severity", "code", "value", "n", "sample_ids"))).alias("issues"))
    by = lambda c, name: rows.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("unassigned")).alias("k")).agg(F.count("*").alias("v")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(name))
    out = counts
    mark = canonical_fingerprint(rows, rows.columns, "sample_id")
    for p in (first, by("label", "labels"), by("split", "splits"), by("ecosystem", "ecosystems"), mark):
        out = out.crossJoin(F.broadcast(p))
    return out.withColumn("passed", F.col("errors") == 0).withColumn("truncated", F.col("n_issues") > max_issues)


def split_isolation(rows: DataFrame) -> DataFrame:
    """Training rows: groups and representations that cross splits, and representations with both labels."""
    f = lambda code, key, what: rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count_distinct(what).alias("k"), F.count("*").alias("n")).filter("k > 1").select(F.lit(code).alias("code"), "value", "n")
    return f("group-crosses-splits", "group_id", "split").unionByName(f("representation-crosses-splits", "representation_hash", "split")).unionByName(f("conflicting-labels", "representation_hash", "label"))


def require_isolated(rows: DataFrame) -> DataFrame:
    """rows, which raise when read if split_isolation has findings."""
    bad = split_isolation(rows).agg(F.count("*").alias("_bad"), F.min(F.concat_ws(" ", "code", "value")).alias("_first"))
    return rows.crossJoin(F.broadcast(bad)).filter(F.when(F.col("_bad") == 0, True).otherwise(F.raise_error(F.concat(F.lit("splits are not isolated: "), "_first")).cast("boolean"))).drop("_bad", "_first")


def duplicate_groups(edges: DataFrame, sample: str = "sample", key: str = "key") -> DataFrame:
    """(sample, group): transitive closure over shared keys; the group is the smallest sample in it.

    Labels travel from samples to keys and back, and each round also jumps to the label of the label, so the
    number of rounds grows with the logarithm of the longest chain. Each round is aggregates with map-side combine
    and is written to the shared checkpoint folder.
    """
    e = edges.select(F.col(sample).alias("s"), F.col(key).alias("k")).filter("s is not null and k is not null").distinct()
    e = checkpointed(e)
    label = checkpointed(e.groupBy("s").agg(F.col("s").alias("g")))
    while True:
        least = e.join(label, "s").groupBy("k").agg(F.min("g").alias("m"))
        near = e.join(least, "k").groupBy("s").agg(F.min("m").alias("m"))
        hop = label.select(F.col("s").alias("m"), F.col("g").alias("mm"))
        new = checkpointed(near.join(hop, "m", "left").join(label, "s").select("s", F.least("m", F.coalesce("mm", "m"), "g").alias("n"), "g"))
        changed = new.filter("n <> g").limit(1).count()
        label = new.select("s", F.col("n").alias("g"))
        if not changed:
            return label.select(F.col("s").alias(sample), F.col("g").alias("group"))


def grouping_summary(groups: DataFrame) -> DataFrame:
    g = groups.groupBy("group").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("samples"), F.count("*").alias("groups"), F.count_if(F.expr("n > 1")).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("samples_in_duplicate_groups"), F.max("n").alias("largest_group"))


def alternating_split(groups: DataFrame, study: str, first: str = "development", second: str = "holdout", most: int | None = None) -> DataFrame:
    """(group, position, split): groups in the order of a study's hash, alternately to two splits.

    Positions come from hash ranges: counts per range are summed once, and each range is numbered by itself.
    """
    h = groups.select("group").distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{study}|"), F.col("group").cast("string")), 256)).withColumn("b", F.substring("h", 1, 3))
    before = h.groupBy("b").agg(F.count("*").alias("c")).select("b", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    n = h.join(F.broadcast(before), "b").select("group", (F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", "group")) - 1).alias("position"))
    n = n if most is None else n.filter(F.col("position") < most)
    return n.select("group", "position", F.when(F.col("position") % 2 == 0, first).otherwise(second).alias("split"))


def exclude_overlapping_groups(rows: DataFrame, other: DataFrame, keys: list[str], group: str = "group_id") -> DataFrame:
    """rows without every group that has a member which shares one of the keys with other."""
    hit = None
    for k in keys:
        h = rows.join(other.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_semi").select(group)
        hit = h if hit is None else hit.union(h)
    return rows.join(hit.distinct(), group, "left_anti").select(*rows.columns)


def overlap_counts(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(key, shared): distinct values that both sides have."""
    out = None
    for k in keys:
        s = rows.select(F.col(k).alias("v")).filter("v is not null").intersect(other.select(F.col(k).alias("v")).filter("v is not null")).agg(F.count("*").alias("shared")).select(F.lit(k).alias("key"), "shared")
        out = s if out is None else out.union(s)
    return out


def closest_subset(sizes: DataFrame, target: int, seed: int = 0, key: str = "label") -> DataFrame:
    """Whole groups, taken in seeded hash order, whose sizes sum as close to target as any choice can; per key.

    The state of a key is one bit per reachable sum up to target and one back pointer per sum, whatever the rows.
    """
    ordered = sizes.withColumn("rank", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("group_id").cast("string")), 256))

    def choose(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["rank", "group_id"])
        reach: dict[int, tuple[int, int] | None] = {0: None}
        for i, n in enumerate(pdf["n"].tolist()):
            for s in sorted(reach, reverse=True):
                if s + n not in reach and s + n <= 2 * target:
                    reach[s + n] = (s, i)
        best = min(reach, key=lambda s: (abs(s - target), s))
        chosen = set()
        while reach[best] is not None:
            best, i = reach[best]
            chosen.add(i)
        return pd.DataFrame({key: pdf[key], "group_id": pdf["group_id"], "n": pdf["n"], "chosen": [i in chosen for i in range(len(pdf))]})

    kinds = dict(sizes.dtypes)
    return ordered.groupBy(key).applyInPandas(choose, f"{key} {kinds[key]}, group_id {kinds['group_id']}, n {kinds['n']}, chosen boolean")


def verify_plan(plan: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows of plan and observed (key sha256, size, filename) that do not match one to one, with the reason."""
    p = plan.select("filename", F.col("sha256").alias("want_sha"), F.col("size").alias("want_size"))
    o = observed.select("filename", F.col("sha256").alias("got_sha"), F.col("size").alias("got_size"))
    reason = F.when(F.col("got_sha").isNull(), "missing").when(F.col("want_sha").isNull(), "unexpected").when(F.col("want_size") != F.col("got_size"), "size").when(F.col("want_sha") != F.col("got_sha"), "sha256")
    return p.join(o, "filename", "full_outer").withColumn("reason", reason).filter("reason is not null").select("filename", "reason")


def select_artifact(files: DataFrame, max_size: int = 10_000_000, hosts: tuple[str, ...] = ("files.example.invalid",)) -> DataFrame:
    """Per project and version the preferred file that may be fetched: wheel before archive before zip, then by name and digest."""
    kind = F.when(F.col("filename").endswith(".whl"), 0).when(F.col("filename").endswith(".tar.gz"), 1).when(F.col("filename").endswith(".zip"), 2)
    ok = (~F.coalesce("yanked", F.lit(False))) & kind.isNotNull() & F.col("size").between(1, max_size) & F.col("sha256").rlike("^[0-9a-f]{64}$") & F.regexp_extract("url", "^https://([^/:]+)/", 1).isin(*hosts)
    best = files.filter(ok).groupBy("project", "version").agg(F.min_by(F.struct("filename", "url", "sha256", "size"), F.struct(kind, "filename", "sha256")).alias("f"))
    return best.select("project", "version", "f.*")
