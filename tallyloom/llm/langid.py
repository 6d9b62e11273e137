"""Operator 10: language identification by Bayesian fusion of evidence.

For each row the posterior over languages is the product of

* the likelihood of the text under a letter-trigram model per language, learnt from labelled documents by
  counting; its weight is bounded, since the trigrams of a long text aren't independent;
* the probability of the declared markup language given each language, estimated over all rows from how
  declarations and texts agree;
* a prior of the host, smoothed towards its domain, that towards the address suffix, that towards all rows;
  at each level from sums of the other rows' text posteriors, by grouped aggregation.

One more class, unknown, has the same probability for every trigram: text that no language explains better
than chance is unknown, and so is text without letters.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, shared_dir, tidy, written
from tallyloom.llm.textbytes import text_slices

#: Cells of the hashed trigram model per language, the trigrams a text counts as at most, strength of each smoothing step.
CELLS, MOST_TRIGRAMS, STRENGTH = 1 << 14, 60, 4.0
#: More labels than this are taken for a wrong column.
MOST_LANGUAGES = 512
UNKNOWN = "unknown"

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


@dataclass(frozen=True)
class TextModel:
    """``logp``: a row per language, then one for unknown; natural logarithms per trigram cell."""

    languages: tuple[str, ...]
    logp: np.ndarray


def _trigrams(column: pa.Array):
    """(cells, row of each, rows) of consecutive rows: trigrams of letters and the spaces between words."""
    for data, offsets in text_slices(column, 1 << 20):
        x = _LETTER[data]
        if len(x) < 3:
            yield np.zeros(0, np.int32), np.zeros(0, np.int32), len(offsets) - 1
            continue
        word = x.astype(np.uint32)
        word = word[:-2] << 16 | word[1:-1] << 8 | word[2:]
        row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        blank = x == 0x20
        fine = (row[:-2] == row[2:]) & ~(blank[:-2] & blank[1:-1]) & ~(blank[1:-1] & blank[2:])
        cells = ((word[fine] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)
        yield cells, row[:-2][fine], len(offsets) - 1


def train_text_model(docs: DataFrame, label_col: str = "lang", text_col: str = "text") -> TextModel:
    """Trigram counts of all labelled rows and whole texts, with one added to each cell.

    Rows with a null or empty label are left out, and labels without any trigram.  Without labelled rows the model has only unknown.
    """
    rows = docs.filter(F.col(label_col) != "").select(F.col(label_col).alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labels = [r[0] for r in rows.select("label").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(labels) > MOST_LANGUAGES:
        raise ValueError(f"{label_col} has more than {MOST_LANGUAGES} labels")
    labels.sort()
    place = {x: i for i, x in enumerate(labels)}

    def count(batches):
        sums = np.zeros(len(labels) * CELLS, np.int64)
        for batch in batches:
            of = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            at = 0
            for cells, row, n in _trigrams(batch.column(1)):
                sums += np.bincount(of[at + row] * CELLS + cells, minlength=len(sums))
                at += n
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["cell", "n"])

    counts = np.ones(len(labels) * CELLS)
    if labels:
        for cell, n in rows.mapInArrow(tidy(count), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # at most CELLS per language
            counts[cell] += n
    counts = counts.reshape(len(labels), CELLS)
    learnt = counts.sum(axis=1) > CELLS  # a label whose texts have no trigram is no language
    labels, counts = [x for x, some in zip(labels, learnt.tolist(), strict=True) if some], counts[learnt]
    logp = np.log(counts / counts.sum(axis=1, keepdims=True))
    return TextModel(tuple(labels), np.vstack([logp, np.full(CELLS, -np.log(CELLS))]).astype(np.float32))


_DROP = re.compile(r"(?is)<(script|style|noscript|svg|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]+)")


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, declared, host, domain, suffix) of raw pages: visible text, <html lang>, and parts of the address."""
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    raw = pages.select(F.col(id_col).alias("id"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()

    def strip(batches):
        for batch in batches:
            sources = batch.column(2).to_pylist()
            texts = [html.unescape(_DROP.sub(" ", x)) for x in sources]
            declared = [m[1].lower() if (m := _DECLARED.search(x)) else "" for x in sources]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(declared, pa.string())], names=["id", "host", "text", "declared"])

    rows = raw.mapInArrow(tidy(strip), f"id {kind}, host string, text string, declared string")
    return rows.select("id", "text", "declared", "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract("host", r"([^.]+)$", 1).alias("suffix"))


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """(id, language, probability, text_language, declared, host) for each row of (id, text, declared, host, domain, suffix).

    A text without trigrams has language unknown, probability 1.  Null text, declaration or address count as
    empty; an empty declaration says nothing; rows with empty addresses share one host.  Equal probabilities
    go to the language that sorts first.  Repeated ids are rows of their own; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    scratch = shared_dir(spark)
    names = [*model.languages, UNKNOWN]
    size, languages = len(names), len(model.languages)
    kind = rows.schema["id"].dataType.simpleString()
    base = rows.select("id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("declared", "host", "domain", "suffix", "text")])
    logp = model.logp

    def score(batches):
        for batch in batches:
            sums, counts = [], []
            for cells, row, n in _trigrams(batch.column(5)):
                sums.append(np.stack([np.bincount(row, p[cells], n) for p in logp], axis=1))
                counts.append(np.bincount(row, minlength=n))
            if not sums:
                continue
            total, n = np.concatenate(sums), np.concatenate(counts)
            total *= (np.minimum(n, MOST_TRIGRAMS) / np.maximum(n, 1))[:, None]
            flat = pa.array(total.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(total) * size + 1, size, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n), lists], names=["id", "declared", "host", "domain", "suffix", "n", "ll"])

    scored = base.mapInArrow(tidy(score), f"id {kind}, declared string, host string, domain string, suffix string, n long, ll array<double>")
    top = F.array_max("ll")
    odds = F.transform("ll", lambda x: F.exp(x - F.col("top")))
    scored = scored.withColumn("top", top).withColumn("odds", odds).withColumn("all", F.aggregate("odds", F.lit(0.0), lambda a, x: a + x))
    scored = scored.withColumn("post", F.when(F.col("n") > 0, F.transform("odds", lambda x: x / F.col("all"))).otherwise(F.array_repeat(F.lit(0.0), size)))
    known = F.array(*[F.lit(x) for x in names])
    scored = scored.withColumn("text_language", F.when(F.col("n") > 0, F.element_at(known, F.array_position("ll", F.col("top")).cast("int"))).otherwise(UNKNOWN))
    scored = written(scored.drop("top", "odds", "all"), f"{scratch}/scored")

    sums = F.array(*[F.sum(F.element_at("post", i + 1)) for i in range(size)])

    def level(df: DataFrame, value: Column, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(value.alias(f"{by[0]}_votes"))

    parts = [F.sum(F.element_at("host_votes", i + 1)) for i in range(size)]
    hosts = written(level(scored, sums, "host", "domain", "suffix"), f"{scratch}/hosts")
    domains = written(level(hosts, F.array(*parts), "domain", "suffix"), f"{scratch}/domains")
    suffixes = level(hosts, F.array(*parts), "suffix")
    suffixes = checked_broadcast(written(suffixes, f"{scratch}/suffixes"))
    overall = [v or 0.0 for v in (suffixes.agg(*[F.sum(F.element_at("suffix_votes", i + 1)) for i in range(size)]).first())]
    priors = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").select("host", "host_votes", "domain_votes", "suffix_votes")
    priors = checked_broadcast(written(priors, f"{scratch}/priors"))

    # How often each declaration goes with each text language; what isn't a language counts as another.
    said = F.when(F.col("declared").isin(*model.languages) if languages else F.lit(False), F.col("declared")).otherwise("")
    agree = {(a, b): n for a, b, n in scored.filter("n > 0").groupBy(said.alias("a"), F.col("text_language").alias("b")).agg(F.count("*")).collect()}  # languages squared
    declared_given = {a: [np.log((agree.get((a, b), 0) + 1.0) / (sum(agree.get((x, b), 0) for x in model.languages) + max(1, languages))) for b in names] for a in model.languages}

    def smoothed(votes: str, parent: Column) -> Column:
        """Shares of the other rows' votes, with STRENGTH votes from the level above."""
        others = F.zip_with(votes, "post", lambda v, p: F.greatest(v - p, F.lit(0.0)))
        total = F.aggregate(others, F.lit(STRENGTH), lambda a, x: a + x)
        return F.zip_with(others, parent, lambda v, p: (v + STRENGTH * p) / total)

    whole = sum(overall) + size
    joined = scored.join(priors, "host").withColumn("p0", F.array(*[F.lit((v + 1.0) / whole) for v in overall]))
    for votes, name, above in (("suffix_votes", "p1", "p0"), ("domain_votes", "p2", "p1"), ("host_votes", "p3", "p2")):
        joined = joined.withColumn(name, smoothed(votes, F.col(above)))
    declaration = F.array_repeat(F.lit(0.0), size)
    for a, logs in declared_given.items():
        declaration = F.when(F.col("declared") == a, F.array(*[F.lit(float(x)) for x in logs])).otherwise(declaration)
    joined = joined.withColumn("fused", F.zip_with(F.zip_with("ll", "p3", lambda a, b: a + F.log(b)), declaration, lambda a, b: a + b))
    best = F.array_max("fused")
    share = 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    joined = joined.withColumn("best", best)
    some = F.col("n") > 0
    language = F.when(some, F.element_at(known, F.array_position("fused", F.col("best")).cast("int"))).otherwise(UNKNOWN)
    return joined.select("id", language.alias("language"), F.when(some, share).otherwise(1.0).alias("probability"), "text_language", "declared", "host")
