"""Language ID by Bayesian evidence fusion.

The posterior of a language is the product of what the text says (byte trigrams), what the markup declares, what the
address ends in or names, and the prior of the host. Host priors are grouped aggregates of what the texts alone say:
a host is smoothed towards its domain, a domain towards all rows, so that a small host leans on what lies above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import BROADCAST_IDS, bounded_batches, buffers, checkpoint, join_skewed, lists, pieces

#: Labelled rows that the text model is fitted on: those of the least hashes of their ids. All their labels are languages; more than MANY aren't labels of languages, and are refused.
SAMPLE_ROWS, MANY = 4000, 1000
CELLS = 1 << 15
#: Trigrams overlap and repeat, so n of them weigh as n / (1 + n / SATURATION) independent ones.
SATURATION = 200
#: How often a declaration or an address is right; rows that a level of hosts must have to weigh as much as the one above.
DECLARED_RIGHT, ADDRESS_RIGHT, SMOOTHING = 0.9, 0.8, 20.0
#: A row is rejected without a letter or where no language is as probable as this.
LEAST = 0.5

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[0x80:] = np.arange(0x80, 256)
_PLAIN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PLAIN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells of the trigrams around a letter, how many each row has)."""
    raw = _PLAIN[data[offsets[0] : offsets[-1]]].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    cell = ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32)
    fine = raw[1:-1] != 32
    ends = offsets[1:-1] - offsets[0]
    for shift in (1, 2):  # not over two rows
        at = ends - shift
        fine[at[(at >= 0) & (at < len(fine))]] = False
    sums = np.concatenate(([0], np.cumsum(fine)))
    bounds = np.clip(offsets - offsets[0], 0, len(fine))
    return cell[fine], np.diff(sums[bounds])


def fit(rows: DataFrame, *, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each cell in each) from the `sample_rows` labelled rows whose ids have the least hashes."""
    spark = rows.sparkSession
    bounded_batches(spark)
    labelled = rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = labelled.select(F.col(id_col).alias("i")).orderBy(F.xxhash64("i"), "i").limit(sample_rows).distinct()
    sample = labelled.select(F.col(id_col).alias("i"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "i", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, label in enumerate(batch.column("label").to_pylist()):
                cells, _ = _trigrams(data, offsets[i : i + 2])
                held[label] = held.get(label, 0) + np.bincount(cells, minlength=CELLS)
        for label, counts in held.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["label", "cell", "n"])

    counted = checkpoint(sample.select("label", "text").mapInArrow(count, "label string, cell int, n bigint").groupBy("label", "cell").agg(F.sum("n").alias("n")))
    counts = counted.toArrow()  # of the sample, at most a row for each of its trigrams
    names = sorted(set(counts["label"].to_pylist()))
    if len(names) > MANY:
        raise ValueError(f"{len(names)} labels in a sample of {sample_rows} rows: these aren't languages")
    table = np.full((len(names), CELLS), 0.5)
    if names:
        at = {n: i for i, n in enumerate(names)}
        np.add.at(table, (np.array([at[x] for x in counts["label"].to_pylist()]), counts["cell"].to_numpy()), counts["n"].to_numpy())
        table = np.log(table / table.sum(axis=1, keepdims=True))
        table -= table.mean(axis=0)
    return names, table.astype(np.float32)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lo, hi in pieces(offsets):
                cells, n = _trigrams(data, offsets[lo : hi + 1])
                sums = np.zeros((hi - lo, len(model)))
                full = np.flatnonzero(n)
                if len(full):
                    begins = (np.cumsum(n) - n)[full]
                    for i, table in enumerate(model):
                        sums[full, i] = np.add.reduceat(table[cells].astype(np.float64), begins)
                logs = sums / (1 + n / SATURATION)[:, None]
                soft = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(model) else logs
                soft = soft / soft.sum(axis=1, keepdims=True) if len(model) else soft
                own = batch.slice(lo, hi - lo)
                width = np.full(hi - lo, len(model))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("id", "text_hash", "host", "declared", "address")), pa.array(n, pa.int64()), lists(logs.ravel(), width), lists(soft.ravel(), width)], ["id", "text_hash", "host", "declared", "address", "n", "logs", "soft"])

    return run


def _evidence(says: Column, names: list[str], right: float) -> Column:
    """Log-likelihoods of what is declared under each language; none where nothing known is declared."""
    wrong = (1 - right) / max(1, len(names) - 1)
    known = F.lower(F.regexp_extract(says, "^([A-Za-z]{2,3})", 1))
    each = F.array(*[F.when(known == x, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log(wrong)))) for x in names])
    return F.when(known.isin(names), each).otherwise(F.array(*[F.lit(0.0) for _ in names]))


def _level(rows: DataFrame, key: str, n: int, above: DataFrame | None, parent: Column | None, everyone: Column) -> DataFrame:
    """Smoothed priors of each value of `key`: its soft counts and SMOOTHING rows of the level above."""
    grouped = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.sum(F.element_at("soft", i + 1)) for i in range(n)]).alias("sums"))
    if above is not None:
        grouped = grouped.withColumn("domain", parent).join(above.select("domain", F.col("prior").alias("up")), "domain", "left")
        up = F.coalesce("up", everyone)
    else:
        up = everyone
    prior = F.zip_with("sums", up, lambda s, u: (s + SMOOTHING * u) / (F.col("rows") + SMOOTHING))
    return checkpoint(grouped.select(key, prior.alias("prior")))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, address: Column | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, n_letters, language, confidence, rejected) of every row.

    `declared` is the language that markup declares, `host` a host name, `address` what its suffix or path names;
    null where there is none, and what isn't one of the model's languages says nothing. Null and empty texts, and texts
    without a letter, are rejected with the language that the rest points to; equal posteriors go to the first language
    by name. Without a model (no labelled rows) every language is null and all rows are rejected. Null ids stay.
    """
    names, table = model
    bounded_batches(rows.sparkSession)
    none = F.lit(None).cast("string")
    pick = lambda c: (none if c is None else c).cast("string")
    source = rows.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), pick(host).alias("host"), pick(declared).alias("declared"), pick(address).alias("address"), F.col(text_col).alias("text"))
    scored = checkpoint(source.mapInArrow(_score(rows.sparkSession.sparkContext.broadcast(table)), "id bigint, text_hash bigint, host string, declared string, address string, n bigint, logs array<double>, soft array<double>"))
    if not names:
        return scored.select(F.col("id").alias("doc_id"), "text_hash", F.col("n").alias("n_letters"), none.alias("language"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"))
    n = len(names)
    total = scored.where("n > 0").agg(F.count(F.lit(1)), *[F.sum(F.element_at("soft", i + 1)) for i in range(n)]).first()
    everyone = F.array(*[F.lit(((total[i + 1] or 0.0) + 1) / (total[0] + n)) for i in range(n)])
    labels = F.split("host", r"\.")
    domain = lambda: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")
    seen = scored.where("n > 0").withColumn("domain", domain())
    domains = _level(seen, "domain", n, None, None, everyone)
    hosts = _level(seen, "host", n, domains, domain(), everyone)
    small = hosts.limit(BROADCAST_IDS // 100 + 1).count() <= BROADCAST_IDS // 100
    fused = scored.join(F.broadcast(hosts), "host", "left") if small else join_skewed(scored, hosts, "host")
    prior = F.transform(F.coalesce("prior", everyone), lambda p: F.ln(p))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(add(F.col("logs"), _evidence(F.col("declared"), names, DECLARED_RIGHT)), _evidence(F.col("address"), names, ADDRESS_RIGHT)), prior)
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    confidence = 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    language = F.element_at(F.array(*map(F.lit, names)), F.array_position("logs", F.col("top")).cast("int"))
    return fused.select(F.col("id").alias("doc_id"), "text_hash", F.col("n").alias("n_letters"), language.alias("language"), confidence.alias("confidence"), ((F.col("n") == 0) | (confidence < least)).alias("rejected"))


def identify_documents(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`identify` for the documents table: `lang` labels the sample, `source` is the host. Documents declare nothing: what labels the model is no evidence too."""
    model = fit(docs, id_col="doc_id", text_col="text", label_col="lang", sample_rows=sample_rows)
    return identify(docs, model, host=F.col("source"))


def page_evidence(html: str = "html", url: str = "url") -> dict[str, Column]:
    """What a page says of its language: the lang of its html tag, its host, and the language its path or suffix names."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return {"declared": F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1), "host": F.when(host != "", host), "address": F.when(path != "", path).otherwise(suffix)}
