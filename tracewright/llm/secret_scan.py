"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base spans come from three fixed patterns over whole texts. Candidates are their secret values and
any other long mixed token; the hash of each is counted over the whole corpus by distinct
repositories and owners. A value that many owners hold is a copied example; a value that at most
`max_owners` owners and `max_repos` repositories hold looks live, and where no base span covers it,
it is added as a span of kind `owned`. Base spans always stay.

Spans are start:end in code points, end exclusive. Defined results: a null text is empty; a null
owner or repository counts as one owner or repository of its own; rows equal in id and text give
equal rows; an empty table gives an empty table; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Kinds in their listed order, with pattern, the group of the secret value and the least length of it.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "owned")
#: access and hex have their least length in the pattern: each match is a maximal run, so that dropping short ones comes to the same.
PATTERNS = {"assign": (ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]{14,}", 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16)}
WIDE = r"[A-Za-z0-9+/_-]{20,}"
SPAN = "array<struct<kind:int,start:bigint,end:bigint,hash:bigint>>"


def spans_of(text: str, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of a pattern in a column, as spans.

    Splitting gives the texts between matches; their lengths and those of the matches add up to positions.
    """
    between, found = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)

    def fold(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.xxhash64(value(x["m"])).alias("hash"))
        return F.struct(end.alias("at"), F.when(F.length(value(x["m"])) >= least, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    return F.when(F.col(text).rlike(pattern), F.aggregate(pairs, zero, fold, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def scanned(docs: DataFrame, owner: str, repo: str, text: str = "text") -> DataFrame:
    """One narrow row per document: its key columns, owner, repo, base spans, and wide candidates outside them."""
    df = docs.select(F.col("doc_id"), F.col(owner).alias("_owner"), F.col(repo).alias("_repo"), text_of(text).alias("_text"))
    df = df.withColumn("_base", F.concat(*[spans_of("_text", k, *PATTERNS[name]) for k, name in enumerate(KINDS[:3])]))
    covered = lambda s: F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    mixed = lambda s: F.substring("_text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    wide = F.filter(spans_of("_text", 3, WIDE, 0, 20), lambda s: ~covered(s) & mixed(s).rlike("[0-9]") & mixed(s).rlike("[A-Za-z]"))
    df = df.withColumn("_wide", wide)
    return df.select("doc_id", F.xxhash64("_text").alias("_key"), F.xxhash64("_owner").alias("_owner"), F.xxhash64("_repo").alias("_repo"), "_base", "_wide")


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates (hash, _owner, _repo) to one row per hash: owners, repos.

    Distinct pairs first, which spread a hot hash over its owners and repositories; the counts then combine before the shuffle.
    """
    owners = candidates.select("hash", "_owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repos = candidates.select("hash", "_repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repos"))
    return owners.join(repos, "hash")


def find_secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id", text: str = "text", max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """One row per document: doc_id, _key (hash of the text), base and spans (arrays of kind, start, end), n_owned, n_copied.

    n_owned: candidates that look live; n_copied: candidates that are widely copied.
    """
    rows = cut(scanned(docs, owner, repo, text))
    each = rows.select("doc_id", "_key", "_owner", "_repo", F.explode(F.concat("_base", "_wide")).alias("s")).select("doc_id", "_key", "_owner", "_repo", "s.*")
    known = ownership(each)
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = each.select("doc_id", "_key", "kind", "start", "end", "hash").distinct().join(known, "hash").withColumn("live", live)
    span = F.struct("kind", "start", "end")
    by_doc = judged.groupBy("doc_id", "_key").agg(
        F.collect_list(F.when(F.col("live") & (F.col("kind") == 3), span)).alias("_added"),
        F.count_if("live").alias("n_owned"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    by_doc = by_doc.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_added", "n_owned", "n_copied")
    out = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return out.select("doc_id", "_key", plain("_base").alias("base"), F.concat(plain("_base"), F.coalesce("_added", none)).alias("spans"), F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def joined(spans: str) -> Column:
    """kind:start:end by start, then kind as listed, with commas between."""
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(by_start, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), "n_owned", "n_copied")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span replaced by mark; spans that touch or overlap are replaced as one."""
    fold = lambda a, s: F.struct(
        F.when(s["start"] <= a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct((s["start"]).alias("start"), s["end"].alias("end"))))
    first = F.get(ordered, F.lit(0))
    zero = F.struct(F.when(first["start"] == 0, F.lit(mark)).otherwise(F.lit("")).alias("out"), F.lit(0).cast("bigint").alias("at"))
    whole = F.aggregate(ordered, zero, fold, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with its secrets masked and n_chars counted anew. Columns may have any names.

    Only the few documents that have a span meet the join with their texts.
    """
    found = cut(find_secrets(docs).where(F.size("spans") > 0).select("doc_id", "_key", "spans").dropDuplicates(["doc_id", "_key"]))
    found = found.select(F.col("doc_id").alias("d"), F.col("_key").alias("k"), "spans")
    texts = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("key"))
    out = texts.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    hit, text = F.col("spans").isNotNull(), F.when(F.col("spans").isNotNull(), masked(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        n = F.col("row.n_chars")
        changed["n_chars"] = F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(n)
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
