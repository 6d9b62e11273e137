"""Exact inner-product retrieval, rendering of results, cached replay, ranking of web hits, seeded samples."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.errors import RetrievalError
from tallyloom.functions.text import trim
from tallyloom.sources.scratch import scratch_dir, written

# Hosts of exchanges and regulators, which come first.
PREFERRED_DOMAINS = ("cninfo.com.cn", "sse.com.cn", "szse.cn", "csrc.gov.cn", "hkexnews.hk")
SEARCH_LIMIT, DOCUMENT_LIMIT, TOP_K = 6, 3, 3
#: Bytes of query vectors that may go to every task.
FEW_BYTES = 8 << 20
#: Queries, and records, that meet at a time in a task; their pairs that are added up again at a time.
TILE, PAIRS = 512, 1 << 14


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(queries: DataFrame, records: DataFrame, k: int = TOP_K, strict: bool = False, query_vector: str = "vector", vector: str = "embedding", query_id: str = "query_id", id_col: str = "fact_id", text: str | None = "query", blocks: int = 64, few_bytes: int = FEW_BYTES) -> DataFrame:
    """Each query's ``k`` best records with ``score`` and ``rank``: highest product, ties to the smaller id.

    A blank query or ``k`` below 1 gives nothing, with ``strict`` an error.  Records whose vector is null or of another length
    than a query's take no part for it.  Queries of at most ``few_bytes`` in all go to the records as they lie; more are dealt to
    passes of half as much, and the records, written once in ``blocks`` parts, are read once per pass.  The work is the product of
    both counts; what the driver and a task hold at a time is not.
    """
    if k < 1 and strict:
        raise RetrievalError("k must be at least 1")
    asked = queries.withColumnRenamed(query_vector, "__q")
    if text and text in queries.columns:
        some = F.coalesce(trim(F.col(text)) != "", F.lit(False))
        asked = asked.filter(F.assert_true(some, "query must not be blank").isNull()) if strict else asked.filter(some)
    asked = asked.filter("__q is not null")
    size = asked.agg(F.coalesce(F.sum(F.size("__q")), F.lit(0)) * 8, F.count("*")).first()
    held = size[0] + 64 * size[1]
    if k < 1 or not size[1]:
        return records.drop(vector).limit(0).crossJoin(asked.drop("__q")).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(1))
    spark = records.sparkSession
    if held <= few_bytes:
        best = _pass(asked, records, k, query_id, vector, id_col)
    else:
        scratch, passes = scratch_dir(spark), min(math.ceil(2 * held / max(few_bytes, 1)), size[1])
        dealt = asked.select(query_id, "__q", F.floor(F.rand(0) * passes).cast("int").alias("__pass"))
        dealt.write.partitionBy("__pass").parquet(f"{scratch}/queries")
        dealt = spark.read.schema(dealt.schema).parquet(f"{scratch}/queries")
        records = written(records.repartition(blocks), f"{scratch}/records")
        for i in range(passes):
            own = dealt.filter(F.col("__pass") == i)
            _pass(own, records, k, query_id, vector, id_col).write.mode("append").parquet(f"{scratch}/best")
        best = spark.read.parquet(f"{scratch}/best")
    return best.join(asked.drop("__q"), query_id)


def _pass(asked: DataFrame, records: DataFrame, k: int, query_id: str, vector: str, id_col: str) -> DataFrame:
    """The ``k`` best records of each of a pass's queries (``query_id``, ``__q``), which come to the driver, with ``score`` and ``rank``."""
    rows = asked.select(query_id, "__q").collect()
    named = records.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"__nth int, `{query_id}` {asked.schema[query_id].dataType.simpleString()}")
    met = _products(records, rows, k, vector, id_col)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("__nth").orderBy(F.desc("score"), F.col(id_col)))).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(named), "__nth").drop("__nth")


def _products(records: DataFrame, rows: list, k: int, vector: str, id_col: str) -> DataFrame:
    """Records without their vectors, with ``score`` and ``__nth``, the query's place in ``rows``: all that may be among a query's ``k`` best.

    A tile of queries and records is one matrix product.  It only turns away: what it leaves within rounding of the ``k`` best so far
    is added up again, left to right, as :func:`inner_product` does, so that equal vectors have equal scores wherever they lie.
    """
    keep = [c for c in records.columns if c != vector]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in {len(r[1]) for r in rows}:
        own = [i for i, r in enumerate(rows) if len(r[1]) == length]
        by_length[length] = np.array(own), np.array([rows[i][1] for i in own], float).reshape(len(own), length)
    high = max(1, min(TILE, TILE * TILE // (4 * k)))

    def exact(a, b):
        total = np.zeros(len(a))
        for i in range(a.shape[1]):
            total += a[:, i] * b[:, i]
        return total

    def candidates(queries, vectors, least):
        """Places of queries and of records, and scores, of a tile's pairs that aren't below each query's ``least``."""
        with np.errstate(all="ignore"):
            scores = queries @ vectors.T
            slack = 4e-16 * (queries.shape[1] + 1) * np.linalg.norm(queries, axis=1) * np.max(np.linalg.norm(vectors, axis=1), initial=0) + 1e-300
            floor = least - slack
            near = ~(scores < floor[:, None])
            if len(vectors) > k and np.count_nonzero(near) > 4 * k * len(queries):
                top = np.partition(scores, len(vectors) - k, axis=1)[:, len(vectors) - k]
                near = ~(scores < np.fmax(floor, top - 2 * slack)[:, None])
            q, r = np.nonzero(near)
            parts = [exact(queries[q[i : i + PAIRS]], vectors[r[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)]
            return q, r, np.concatenate([np.empty(0), *parts])

    def best(batches):
        tops = {length: np.full(len(own), -np.inf) for length, (own, _) in by_length.items()}
        for batch in batches:
            lists = batch.column(len(keep))
            place = pc.rank(batch.column(keep.index(id_col)), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            lengths = np.array(pc.fill_null(pc.list_value_length(lists), -1))
            for length, (own, matrix) in by_length.items():
                at, top = np.flatnonzero(lengths == length), tops[length]
                flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), length)
                for q0 in range(0, len(own) if len(at) else 0, high):
                    queries, kept = matrix[q0 : q0 + high], None
                    for r0 in range(0, len(at), TILE):
                        q, r, s = candidates(queries, flat[r0 : r0 + TILE], top[q0 : q0 + high])
                        if kept and not len(q):
                            continue
                        new = q, at[r + r0], s
                        q, r, s = (np.concatenate(x) for x in zip(kept, new, strict=True)) if kept else new
                        order = np.lexsort((place[r], -s, ~np.isnan(s), q))
                        q, r, s = q[order], r[order], s[order]
                        first = np.arange(len(q)) - np.searchsorted(q, q) < k
                        q, r, s = kept = q[first], r[first], s[first]
                        full = np.flatnonzero(np.bincount(q, minlength=len(queries)) == k)
                        top[q0 + full] = np.fmax(top[q0 + full], s[np.searchsorted(q, full, side="right") - 1])
                    q, r, s = kept
                    for i in range(0, len(q), len(batch)):
                        some = slice(i, i + len(batch))
                        out = batch.take(pa.array(r[some]))
                        yield pa.RecordBatch.from_arrays([*out.columns[: len(keep)], pa.array(s[some]), pa.array(own[q[some] + q0], pa.int32())], names=[*keep, "score", "__nth"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*keep).schema.fields)
    return records.select(*keep, vector).mapInArrow(best, f"{fields}, score double, __nth int")


def spaced_json(r: Column, fields: list[str]) -> Column:
    """A flat struct as JSON with a blank after commas and colons; null fields stay."""
    value = lambda c: F.regexp_replace(F.to_json(F.array(r[c])), r"^\[|\]$", "")
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), value(c)) for c in fields]), F.lit("}"))


def format_results(query: Column, records: Column, fields: list[str] | None = None) -> Column:
    """The text for the model: a numbered list, and the records without scores as JSON in a comment.

    With the records' ``fields`` the JSON has blanks after commas and colons.
    """
    cell = lambda r, c: F.coalesce(r[c].cast("string"), F.lit(""))
    line = lambda r, i: F.concat((i + 1).cast("string"), F.lit(". ["), cell(r, "entity"), F.lit("] "), cell(r, "metric"), F.lit(": "), cell(r, "value_text"), F.lit(" （来源: "), cell(r, "source_doc"), F.lit("）"))
    head = F.concat(F.lit("搜索结果（共 "), F.size(records).cast("string"), F.lit(" 条）：\n"))
    listed = F.concat(F.lit('{"records": ['), F.array_join(F.transform(records, lambda r: spaced_json(r, fields)), ", "), F.lit("]}")) if fields else F.to_json(F.struct(records.alias("records")), {"ignoreNullFields": "false"})
    tail = F.concat(F.lit("\n<!-- metadata: "), listed, F.lit(" -->"))
    found = F.array_join(F.concat(F.array(head), F.transform(records, line), F.array(tail)), "\n")
    nothing = F.concat(F.lit('[search] 未找到与 "'), query, F.lit('" 相关的结果。'))
    return F.when(F.coalesce(F.size(records), F.lit(0)) > 0, found).otherwise(nothing)


def format_facts(records: Column) -> Column:
    """The other text: facts with sources and addresses, a blank line between."""
    part = lambda r, i: F.concat(F.lit("[fact "), (i + 1).cast("string"), F.lit("] "), r["fact"], F.lit("\nsource: "), r["source_doc"], F.lit("\nurl: "), r["source_url"])
    return F.array_join(F.transform(records, part), "\n\n")


def format_evidence(documents: Column) -> Column:
    """Pages read: title, address and content, a blank line between."""
    part = lambda d, i: F.concat(F.lit("[source "), (i + 1).cast("string"), F.lit("] title: "), d["title"], F.lit("\nurl: "), d["url"], F.lit("\ncontent: "), d["text"])
    return F.array_join(F.transform(documents, part), "\n\n")


def retrieve(results: DataFrame, fields: list[str], query_id: str = "query_id", query: str = "query") -> DataFrame:
    """One row per query of ``search``: its text and its records; a query's records are at most its k."""
    records = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("r")))), lambda x: x["r"])
    one = results.groupBy(query_id, query).agg(records.alias("records"))
    return one.withColumn("text", format_results(F.col(query), F.col("records"), fields))


def sample_facts(df: DataFrame, n: int, seed: int = 0, entity: str | None = None, id_col: str = "fact_id") -> DataFrame:
    """``n`` rows in a seeded order, of one entity if given; all if there are fewer."""
    df = df.filter(F.col("entity") == entity) if entity else df
    return df.orderBy(F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))), 256), id_col).limit(max(n, 0))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def is_preferred(url: Column, domains=PREFERRED_DOMAINS) -> Column:
    """Whether an address is of a preferred domain or below one."""
    host, out = host_of(url), F.lit(False)
    for d in domains:
        out = out | (host == d) | F.endswith(host, F.lit(f".{d}"))
    return out


def rank_hits(hits: DataFrame, key: str = "query", url: str = "url", order: str = "place", domains=PREFERRED_DOMAINS, limit: int | None = None, readable: Column | None = None) -> DataFrame:
    """Hits per query: preferred domains first, then shorter addresses, then as found; ``limit`` counts readable ones."""
    df = hits.filter(readable) if readable is not None else hits
    w = Window.partitionBy(key).orderBy(F.desc(is_preferred(F.col(url), domains)), F.length(url), order)
    out = df.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= limit) if limit is not None else out


def is_url_query(query: Column) -> Column:
    """Whether a query is the address of a page to read."""
    return trim(query).rlike(r"^https?://[^/?#]+")


def unwrap_redirect(url: Column, parameter: str = "uddg") -> Column:
    """The address that a search engine's redirect leads to; others stay."""
    inner = F.try_url_decode(F.regexp_extract(url, rf"[?&]{parameter}=([^&#]+)", 1))
    return F.when(inner != "", inner).otherwise(F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url))


def is_public_url(url: Column) -> Column:
    """What an address shows of being public: http, no local name, no private or reserved number."""
    host = host_of(url)
    private = r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(?:22[4-9]|2[34]\d|25[0-5])\.|^\[|^\d+$"
    return F.coalesce(url.rlike("^(?i)https?://") & (host != "") & (host != "localhost") & ~F.endswith(host, F.lit(".local")) & ~F.endswith(host, F.lit(".localhost")) & ~host.rlike(private), F.lit(False))


def cache_key(query: Column) -> Column:
    return F.sha2(trim(query), 256)


def replay(queries: DataFrame, cache: DataFrame, query: str = "query") -> tuple[DataFrame, DataFrame]:
    """(queries found in the cache with text, metadata and ``cached``, those to be computed).

    ``cache`` is keyed by the hash of the trimmed query; of repeated keys the earliest entry counts.
    """
    keyed = queries.withColumn("key", cache_key(F.col(query)))
    entries = cache.groupBy("key").agg(F.min_by(F.struct("text", "metadata"), F.struct("created_at", "text")).alias("e"))
    hits = keyed.join(entries, "key").select(*queries.columns, "key", "e.text", "e.metadata", F.lit(True).alias("cached"))
    return hits, keyed.join(entries, "key", "left_anti")


def cache_entries(results: DataFrame, query: str = "query") -> DataFrame:
    """New cache rows (key, created_at, text, metadata) of computed results (query, text, metadata)."""
    return results.select(cache_key(F.col(query)).alias("key"), F.current_timestamp().alias("created_at"), "text", "metadata")


def write_cache(results: DataFrame, path: str, query: str = "query") -> None:
    """Append computed results to a cache table; :func:`replay` reads it."""
    cache_entries(results, query).write.mode("append").parquet(path)


def normalise_payload(payload: Column) -> Column:
    """struct(text, metadata) of a service's JSON answer: a text, or an object with a text and other fields; else null."""
    v = F.try_parse_json(payload)
    kind = F.schema_of_variant(v)
    text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == "STRING", F.try_variant_get(v, "$.text", "string"))
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    rest = F.map_filter(fields, lambda k, _: k != "text")
    return F.when(text.isNotNull(), F.struct(text.alias("text"), F.to_json(rest).alias("metadata")))
