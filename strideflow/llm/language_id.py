"""Language identification by Bayesian evidence fusion.

The posterior of a page's language adds the logs of a text likelihood
(character trigrams of the page's visible text), the likelihoods of its
declared markup language and of its address suffix, and a prior of its host.
How likely a language's pages declare a code, or stand under a suffix, is
counted over all pages by grouped aggregation of the text evidence, so a
declaration is trusted as far as the texts bear it out.  Host priors are
smoothed hierarchically in the same way: a host leans on its domain, the
domain on all pages.  The suffix is one piece of evidence, not a level too.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stage, task, text_slices

CELLS = 1 << 14  # hashed trigrams of the text model
TEXT_WEIGHT = 0.5  # neighbouring trigrams overlap: each counts for less than one observation
SMOOTHING = 8.0  # pages that the next wider level, or the belief before any count, counts as
TRUST = 0.9  # belief before any count: share of declarations and national suffixes that are right

_DROP = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.IGNORECASE | re.DOTALL)
_LANG = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
# Languages of national suffixes, as believed before any count.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}


def visible(page: str | None) -> str:
    return " ".join(html.unescape(_DROP.sub(" ", page or "")).split())


def _cells(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram cells of a slice's bytes and their rows."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    low = np.where((low < 97), 32, low).astype(np.uint64)  # letters and non-ASCII bytes only
    gram = (low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    keep = (row[:-2] == row[2:]) & (gram != 0x202020)
    return (mix64(gram[keep]) % np.uint64(CELLS)).astype(np.int64), row[:-2][keep]


def _tally(text: str, lang: str):
    """Partial trigram counts of each language seen by a task."""

    @task
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(batch.schema.get_field_index(lang)).to_pylist(), dtype=object)
            for i, j, data, offs in text_slices(batch.column(batch.schema.get_field_index(text))):
                cell, row = _cells(data, offs)
                for name in set(names[i:j]):
                    own = names[i:j] == name
                    sums.setdefault(name, np.zeros(CELLS, np.int64))
                    sums[name] += np.bincount(cell[own[row]], minlength=CELLS)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "cell", "n"])

    return run


def text_model(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of every cell in each, counted over
    all documents with a language.  At most ``CELLS`` rows a language."""
    known = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = known.mapInArrow(_tally("text", "lang"), "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    lang_of = rows.column("lang").combine_chunks().dictionary_encode()
    if isinstance(lang_of, pa.ChunkedArray):
        lang_of = lang_of.combine_chunks()
    seen = lang_of.dictionary.to_pylist()
    names = sorted(seen)
    counts = np.full((len(names), CELLS), 0.5)
    place = np.array([names.index(x) for x in seen], dtype=np.int64)
    if names:
        counts[place[lang_of.indices.to_numpy()], rows.column("cell").to_numpy()] += rows.column("n").to_numpy()
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)) if names else counts


def _likelihood(names: list[str], table, page: str):
    @task
    def run(batches):
        logs = table.value
        for batch in batches:
            shown = pa.array([visible(v.as_py()) for v in batch.column(batch.schema.get_field_index(page))], pa.string())
            out = np.zeros((batch.num_rows, len(names)))
            for i, j, data, offs in text_slices(shown):
                cell, row = _cells(data, offs)
                for x in range(len(names)):
                    out[i:j, x] = np.bincount(row, weights=logs[x][cell], minlength=j - i)
            out -= out.max(axis=1, keepdims=True) if len(names) else 0
            keep = [c for c in batch.schema.names if c != page]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array((TEXT_WEIGHT * out).tolist(), pa.list_(pa.float64()))], names=[*keep, "text_log"])

    return run


def _posterior(logs: F.Column) -> F.Column:
    top = F.array_max(logs)
    odds = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def _array_sum(name: str, n: int) -> list[F.Column]:
    return [F.sum(F.element_at(name, x + 1)).alias(f"s{x}") for x in range(n)]


def _totals(sums: DataFrame, n: int):
    return sums.agg(F.sum("pages").alias("pages"), *[F.sum(f"s{x}").alias(f"s{x}") for x in range(n)]).head()


def _counted(pages: DataFrame, key: str, said: F.Column, names: list[str]) -> DataFrame:
    """(key, key_log): the log likelihood of each value of ``key`` in each
    language, against its share of all pages.

    A language's share of pages with the value is its soft count over all
    pages, plus ``SMOOTHING`` pages as believed before: ``said`` is the
    language that a value names, right with ``TRUST``; a value that names none
    is as likely in every language.  No value ('') is no evidence.
    """
    n = len(names)
    sums = pages.groupBy(key).agg(F.count("*").alias("pages"), *_array_sum("text_post", n))
    total = _totals(sums, n)
    share = F.col("pages") / F.lit(float(total["pages"] or 1))
    off = (1 - TRUST) / max(n - 1, 1)

    def ratio(x: int) -> F.Column:
        belief = F.when(~said.isin(*names), F.lit(1.0)).when(said == names[x], F.lit(n * TRUST)).otherwise(F.lit(n * off))
        return F.log((F.col(f"s{x}") + SMOOTHING * belief * share) / (((total[f"s{x}"] or 0.0) + SMOOTHING) * share))

    return sums.filter(F.col(key) != "").select(key, F.array(*[ratio(x) for x in range(n)]).alias(f"{key}_log"))


def _priors(pages: DataFrame, n: int) -> DataFrame:
    """(host, prior): each level's soft counts of languages, smoothed by the
    level above."""
    hosts = pages.groupBy("host", "domain").agg(F.count("*").alias("pages"), *_array_sum("text_post", n))
    flat = [1.0 / n] * n
    total = _totals(hosts, n)
    if total["pages"]:
        flat = [(total[f"s{x}"] + SMOOTHING / n) / (total["pages"] + SMOOTHING) for x in range(n)]

    def level(rows: DataFrame, key: str, above) -> DataFrame:
        sums = rows.groupBy(key).agg(F.sum("pages").alias("pages"), *[F.sum(f"s{x}").alias(f"s{x}") for x in range(n)], F.first("above").alias("above"))
        return sums.select(key, F.array(*[(F.col(f"s{x}") + SMOOTHING * F.element_at("above", x + 1)) / (F.col("pages") + SMOOTHING) for x in range(n)]).alias(above))

    mid = level(hosts.withColumn("above", F.array(*[F.lit(x) for x in flat])), "domain", "p_domain")
    hosts = hosts.join(mid, "domain")
    low = level(hosts.withColumn("above", F.col("p_domain")), "host", "prior")
    return low.select("host", "prior")


def identify(pages: DataFrame, docs: DataFrame, *, page_id: str = "page_id", url: str = "url", html_text: str = "html", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per page: page_id, host, declared, suffix, lang, confidence.

    The text model is counted over all of ``docs``.  Null or empty pages rest
    the other evidence; a page without any gets the host prior's language.
    Null or malformed addresses are one host, '', and have no suffix.  Codes
    and suffixes are any text; those that name no known language count for what
    the texts under them are.  Ties go to the first language by name;
    without any labelled document, lang is null.  Repeated rows each get
    their row.
    """
    names, logs = text_model(docs, text=text, lang=lang)
    spark = pages.sparkSession
    base = pages.select(F.col(page_id).alias("page_id"), F.lower(F.coalesce(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))).alias("host"), F.lower(F.coalesce(F.regexp_extract(html_text, _LANG, 1), F.lit(""))).alias("declared"), F.col(html_text).alias("page"))
    base = base.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    if not names:
        return base.select(F.col("page_id").alias(page_id), "host", "declared", "suffix", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    kind = base.schema["page_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(logs)  # CELLS numbers a language
    scored = stage(base.mapInArrow(_likelihood(names, sent, "page"), f"page_id {kind}, host string, declared string, suffix string, domain string, text_log array<double>"), "likelihoods")
    scored = scored.withColumn("text_post", _posterior(F.col("text_log")))
    known = F.array(*[F.lit(x) for x in names])
    national = F.lit("")
    for suffix, name in SUFFIXES.items():
        national = F.when(F.col("suffix") == suffix, F.lit(name)).otherwise(national)
    scored = scored.withColumn("code", F.substring("declared", 1, 2))
    joined = scored.join(_priors(scored, len(names)), "host")
    for key, said in (("code", F.col("code")), ("suffix", national)):
        joined = joined.join(_counted(scored, key, said, names), key, "left")
    told = lambda key, i: F.coalesce(F.get(f"{key}_log", i), F.lit(0.0))
    fused = joined.withColumn("all", F.transform("text_log", lambda x, i: x + told("code", i) + told("suffix", i) + F.log(F.get("prior", i))))
    post = fused.withColumn("post", _posterior(F.col("all")))
    return post.select(F.col("page_id").alias(page_id), "host", "declared", "suffix", F.element_at(known, F.array_position("post", F.array_max("post")).cast("int")).alias("lang"), F.array_max("post").alias("confidence"))
