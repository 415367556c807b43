"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Patterns give candidate spans. The values' hashes are counted over the distinct
repositories and owners of the whole corpus: a value that many owners carry is
a copied example, a value of a few owners is a credential. Values that no base
pattern finds anywhere must also look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import text_or_empty, written

#: The kinds in their listed order, and the patterns of the base kinds.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run matches from its first character on, so its least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Candidates beyond the base kinds; they count only where the corpus shows an owner.
OPAQUE = r"[A-Za-z0-9_-]{20,}"
#: Tested on opaque candidates only; of the base kinds ownership alone decides.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|test|12345678"
#: An opaque value is live-looking from so many bits of entropy a character on; generated keys have about 4 to 6.
LEAST_ENTROPY = 3.5
#: A value of more owners than this is a copied example, and so is one in more repositories, whoever owns them.
MOST_OWNERS, MOST_REPOS = 3, 8
MARK = "[SECRET]"


def _is_opaque(value: Column) -> Column:
    """Letters of both cases and at least four digits, as generated keys have; words and names have not."""
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & (F.regexp_count(value, F.lit("[0-9]")) >= 4)


def entropy(value: Column) -> Column:
    """Bits of Shannon entropy for each character of a value."""
    chars = F.split(value, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    bits = F.transform(F.array_distinct(chars), lambda c: -share(c) * F.log2(share(c)))
    return F.aggregate(bits, F.lit(0.0), lambda a, x: a + x)


def _spans(text: Column, kind: int, pattern: str, value_of, keep) -> Column:
    """The kept matches of a pattern as (start, kind, stop, value), by start, in code points.

    The pieces between matches come from a split by the same pattern, so the
    offsets are sums of piece and match lengths.
    """

    def located(m: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,match:string>>").alias("found"))
        pairs = F.zip_with(m, F.slice(pieces, 1, F.size(m)), lambda a, b: F.struct(a.alias("match"), F.length(b).alias("gap")))
        step = lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.length(p["match"])).alias("at"),
            F.concat(acc["found"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + F.length(p["match"])).alias("stop"), p["match"].alias("match")))).alias("found"),
        )
        found = F.filter(F.aggregate(pairs, first, step)["found"], lambda s: keep(s["match"]))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), value_of(s["match"]).alias("value")))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>")
    return F.element_at(F.transform(F.array(matches), lambda m: F.when(F.size(m) == 0, empty).otherwise(located(m))), 1)


def candidate_spans(text: Column) -> Column:
    """All candidates of a text by start, then kind: (start, kind, stop, hash, credential): of a base kind, or live-looking."""
    whole = lambda m: m
    group = lambda m: F.regexp_extract(m, ASSIGN, 2)
    base = F.concat(
        _spans(text, 0, ASSIGN, group, lambda m: F.length(group(m)) >= 8),
        _spans(text, 1, ACCESS, whole, lambda m: F.lit(True)),
        _spans(text, 2, HEX, whole, lambda m: F.lit(True)),
    )
    more = _spans(text, 3, OPAQUE, whole, _is_opaque)

    def joined(b: Column) -> Column:
        apart = F.filter(more, lambda o: ~F.exists(b, lambda s: (s["start"] < o["stop"]) & (o["start"] < s["stop"])))
        return F.transform(
            F.sort_array(F.concat(b, apart)),
            lambda s: F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.xxhash64(s["value"]).alias("hash"),
                ((s["kind"] < 3) | (~s["value"].rlike(PLACEHOLDER) & (entropy(s["value"]) >= LEAST_ENTROPY))).alias("credential"),
            ),
        )

    return F.element_at(F.transform(F.array(base), joined), 1)


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates(hash, owner, repo, credential) to hash, n_owners, n_repos and whether any of them is a credential.

    Counted level by level, so that a value or an owner with any share of the
    rows is one row for each task before it is shuffled. Repositories belong to
    their owners. Null owners and repositories count as one of their own.
    """
    any_ = F.max("credential").alias("credential")
    repos = candidates.groupBy("hash", "owner", "repo").agg(any_)
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("repos"), any_)
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), any_)


def _scanned(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), F.xxhash64(text_or_empty()).alias("text_key"),
        F.col(owner).alias("owner"), F.col(repo).alias("repo"), candidate_spans(text_or_empty()).alias("found"),
    )


def _judged(scanned: DataFrame, most_owners: int, most_repos: int) -> DataFrame:
    """One row for each candidate span, with the verdict on its value."""
    each = scanned.select("row_id", "doc_id", "text_key", "owner", "repo", F.explode("found").alias("s")).select("row_id", "doc_id", "text_key", "owner", "repo", "s.*")
    known = ownership(each).withColumnRenamed("hash", "of_hash")
    each = each.drop("credential").join(known, F.col("hash") == F.col("of_hash")).drop("of_hash")
    return each.withColumn("live", F.col("credential") & (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos))


def scan(docs: DataFrame, owner: str = "source", repo: str = "lang", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """Secrets of every row of docs(doc_id, text, owner, repo).

    Base spans always count. A value is live if the corpus has it with at most
    most_owners owners and in at most most_repos repositories, and it is of a
    base kind somewhere, or has the entropy of a generated key and no placeholder's words. A candidate of
    kind opaque counts where its value is live.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_opaque,
    n_live, n_examples, and live_repos, the most repositories that one of the
    row's live values lies in (0 without any). Null or empty text has no spans. Null owners count as
    one owner. Repeated rows are scanned each. An empty table gives no rows.
    Other columns of docs are ignored.
    """
    scanned = written(_scanned(docs, owner, repo), "secret-candidates")
    judged = _judged(scanned, most_owners, most_repos).where("kind < 3 or live")
    text_of = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["stop"])
    per_row = judged.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "live"))).alias("all"), F.max(F.when(F.col("live"), F.col("n_repos"))).alias("live_repos"))
    rows = scanned.select("row_id", "doc_id").join(per_row, "row_id", "left")
    found = F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,stop:int,live:boolean>>"))
    n = lambda test: F.size(F.filter("all", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    return rows.withColumn("all", found).select(
        "doc_id", *(n(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(F.array_join(F.transform(F.filter("all", lambda s: s["kind"] < 3), text_of), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("all", text_of), ",").alias("spans"),
        n(of_kind(3)).alias("n_opaque"), n(lambda s: s["live"]).alias("n_live"), n(lambda s: ~s["live"]).alias("n_examples"),
        F.coalesce("live_repos", F.lit(0)).cast("long").alias("live_repos"),
    )


def redact(docs: DataFrame, owner: str = "source", repo: str = "lang", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS, mark: str = MARK) -> DataFrame:
    """docs with every live value in text, as in scan(), replaced by mark; copied examples stay.

    A verdict belongs to a value, so repeated rows and equal ids agree. n_chars
    is set to the new length where docs has it. Rows, other columns and null
    texts are unchanged. Texts are scanned once; rows are found again by doc_id
    and a hash of the text, whatever ids are null or repeated.
    """
    scanned = written(_scanned(docs, owner, repo), "secret-candidates")
    live = _judged(scanned, most_owners, most_repos).where("live").groupBy(F.col("doc_id").alias("__of"), F.col("text_key").alias("__of_key"))
    # Written, so that its size is known and a small table is broadcast instead of shuffling all texts.
    live = written(live.agg(F.sort_array(F.collect_set(F.struct("start", "kind", "stop"))).alias("__live")), "secret-live")
    rows = docs.withColumn("__key", F.xxhash64(text_or_empty())).join(live, F.col("doc_id").eqNullSafe(F.col("__of")) & (F.col("__key") == F.col("__of_key")), "left")

    def cut(spans: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
        step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["text"].alias("text"))).otherwise(
            F.struct(s["stop"].alias("at"), F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("text"))
        )
        done = F.aggregate(spans, first, step)
        return F.element_at(F.transform(F.array(done), lambda d: F.concat(d["text"], F.substring(F.col("text"), d["at"] + 1, F.length(F.col("text"))))), 1)

    rows = rows.withColumn("text", F.when(F.col("__live").isNull() | F.col("text").isNull(), F.col("text")).otherwise(cut(F.col("__live"))))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
