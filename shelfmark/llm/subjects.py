"""Subject areas: averaged word and subword embeddings with one independent logistic output per subject.

A record is the mean of the embeddings of its tokens (words of title and description, the title's words once more as
such, tags as wholes); a token's embedding is the mean of the entries its word and its letter n-grams hash to. Training
is synchronous: in every step each partition computes the gradient over its share of the labelled sample, the sums
meet in the driver (arrays of a size the parameters bound), and the next step starts from one common model.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import collect_small, cut

#: Subjects there may be.
AREAS = 1000


@dataclass(frozen=True)
class Settings:
    """sample: labelled records that train the model, about (the bound); buckets, dimensions: of the embedding table;
    seen: sample records a token must occur in (a fiftieth of the sample's records where that is less, so that a small
    sample keeps some); shares: partitions of the sample; steps, rate, dropout: of the training;
    trusted: step from which labels the model flatly contradicts no longer count; at_least: probability that makes a
    subject; familiar: share of an unknown word's n-grams that must be trained ones for it to count."""

    sample: int = 8000
    buckets: int = 1 << 15
    dimensions: int = 16
    seen: int = 8
    shares: int = 4
    steps: int = 45
    rate: float = 0.1
    dropout: float = 0.3
    trusted: int = 25
    at_least: float = 0.27
    familiar: float = 0.8
    seed: int = 5


MARKUP = re.compile(r"<[^>]*>")
WORD = re.compile(r"[^\W\d_一-鿿]{2,}|[一-鿿]+")
TAG_SIGNS, TAG_BREAK = re.compile(r"[^\W_]+"), re.compile(r"[,;|，；、\n]")
MISREAD = re.compile("Ã[\u0080-¿]|[ã-é][\u0080-¿]{2}")


def _words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        if MISREAD.search(text):
            try:
                text = text.encode("latin-1").decode("utf-8", "ignore")
            except UnicodeEncodeError:
                pass
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = MARKUP.sub(" ", text)
    found = WORD.findall(text.lower())
    if text.isascii():
        return found
    out = []
    for w in found:
        if "一" <= w[0] <= "鿿":
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out.append(w)
    return out


def tokens(name: str | None, desc: str | None, tags: list | None) -> list[str]:
    """Tokens of one record; nulls and blanks have none. Chinese runs are cut into pairs of letters."""
    title = _words(name)
    out = _words(desc) + title + ["t:" + w for w in title]
    for t in tags or ():
        if t:
            for part in TAG_BREAK.split(t):
                k = " ".join(TAG_SIGNS.findall(part.lower()))
                if k:
                    out.append("#" + k)
    return out


def features(word: str, buckets: int) -> list[int]:
    """Table entries of a token: its own, then those of its n-grams of 4 and 5 letters."""
    out = [zlib.crc32(word.encode()) % buckets]
    if len(word) > 3 and word[0].isascii() and word[0] != "#" and word[1] != ":":
        x = f"<{word}>"
        out += [zlib.crc32(x[i : i + n].encode()) % buckets for n in (4, 5) for i in range(len(x) - n + 1)]
    return out


def _grouped(values: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by key."""
    order = np.argsort(keys, kind="stable")
    which, start = np.unique(keys[order], return_index=True)
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(which):
        out[which] = np.add.reduceat(values[order], start, axis=0)
    return out


@dataclass
class Model:
    codes: list[str]
    known: dict[str, int]
    effect: np.ndarray  # what each known token adds to the outputs
    table: np.ndarray  # buckets x outputs
    trained: np.ndarray
    bias: np.ndarray
    settings: Settings


def labelled(labels: DataFrame, areas: DataFrame) -> tuple[DataFrame, list[str]]:
    """(id, y): positions of each id's distinct subjects among the codes (at most AREAS, more is an error); unknown codes and nulls are left out."""
    codes = sorted(r[0] for r in collect_small(areas.where("subject_code is not null").select("subject_code").distinct(), AREAS))
    at = F.array_position(F.array(*(F.lit(c) for c in codes)), F.col("subject_code")) - 1 if codes else F.lit(-1)
    return labels.where("id is not null").select("id", at.cast("int").alias("k")).where("k >= 0").groupBy("id").agg(F.array_sort(F.collect_set("k")).alias("y")), codes


def train(records: DataFrame, labels: DataFrame, areas: DataFrame, settings: Settings = Settings(), skip: str | None = None) -> Model:
    """The model of a bounded sample of labelled records. skip: a condition on id that keeps records out (held-out tests)."""
    s = settings
    marks, codes = labelled(labels, areas)
    if skip:
        marks = marks.where(f"not ({skip})")
    total = max(1, marks.count())
    marks = marks.where(F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(total)) < s.sample)
    chosen = records.join(marks, "id").select("id", "dataset_name", "dataset_desc", "tags", "y").toArrow().sort_by("id").to_pylist()
    lists = [tokens(r["dataset_name"], r["dataset_desc"], r["tags"]) for r in chosen]
    held = Counter(w for x in lists for w in set(x))
    known = {w: i for i, w in enumerate(sorted(w for w, n in held.items() if n >= min(s.seen, max(1, len(lists) // 50))))}
    rng = np.random.default_rng(s.seed)
    k = len(codes)
    table = (rng.normal(size=(s.buckets, s.dimensions)) * 0.1).astype(np.float32)
    out, bias = (rng.normal(size=(k, s.dimensions)) * 0.1).astype(np.float32), np.full(k, -2.0, np.float32)
    parts = [features(w, s.buckets) for w in known]
    if not known or not k:
        return Model(codes, {}, np.zeros((0, k), np.float32), np.zeros((s.buckets, k), np.float32), np.zeros(s.buckets, bool), bias, s)
    count = np.array([len(p) for p in parts])
    flat, start, owner = np.concatenate([np.array(p) for p in parts]), np.cumsum(count) - count, np.repeat(np.arange(len(parts)), count)
    spark = records.sparkSession
    rows = [([known[w] for w in x if w in known], r["y"], i % s.shares) for i, (x, r) in enumerate(zip(lists, chosen))]
    sample = cut(spark.createDataFrame(pa.table({"x": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "y": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "share": pa.array([r[2] for r in rows], pa.int32())})).repartition(s.shares, "share"))
    n, vocabulary, dims = len(rows), len(known), s.dimensions
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (table, out, bias)]
    for step in range(1, s.steps + 1):
        vectors = np.add.reduceat(table[flat], start, axis=0) / count[:, None]
        sent = spark.sparkContext.broadcast((vectors, out, bias))

        def gradient(batches, step=step, sent=sent):
            vectors, out, bias = sent.value
            gv, go, gb = np.zeros((vocabulary, dims), np.float32), np.zeros_like(out), np.zeros_like(bias)
            for b in batches:
                if not b.num_rows:
                    continue
                draw = np.random.default_rng((s.seed, step, int(b.column(2)[0].as_py())))
                x, y = b.column(0), b.column(1)
                length, token = np.diff(np.asarray(x.offsets)), np.asarray(x.flatten())
                row = np.repeat(np.arange(len(length)), length)
                kept = draw.random(len(token)) >= s.dropout
                row, token = row[kept], token[kept]
                size = np.maximum(1, np.bincount(row, minlength=len(length)))[:, None]
                mean = _grouped(vectors[token], row, len(length)) / size
                want = np.zeros((len(length), len(bias)), np.float32)
                want[np.repeat(np.arange(len(length)), np.diff(np.asarray(y.offsets))), np.asarray(y.flatten())] = 1
                error = 1 / (1 + np.exp(-(mean @ out.T + bias))) - want
                if step > s.trusted:
                    error[np.abs(error) > 0.97] = 0
                go += error.T @ mean
                gb += error.sum(0)
                gv += _grouped(((error @ out) / size)[row], token, vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (gv, go, gb)], ["v", "o", "b"])

        sums = sample.mapInArrow(gradient, "v binary, o binary, b binary").toArrow().to_pylist()
        gv, go, gb = (sum(np.frombuffer(r[c], np.float32) for r in sums) / n for c in ("v", "o", "b"))
        sent.unpersist()
        gt = _grouped((gv.reshape(vocabulary, dims) / count[:, None])[owner], flat, s.buckets)
        for a, g, (m, v) in zip((table, out, bias), (gt, go.reshape(out.shape), gb), state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    vectors = np.add.reduceat(table[flat], start, axis=0) / count[:, None]
    trained = np.zeros(s.buckets, bool)
    trained[flat] = True
    return Model(codes, known, vectors @ out.T, table @ out.T, trained, bias, s)


def score(records: DataFrame, model: Model) -> DataFrame:
    """(id, subject_code, probability) of every subject that reaches ``at_least``; records without a known token have none."""
    sent = records.sparkSession.sparkContext.broadcast(model)  # a few MB: bounded by the settings

    def run(batches):
        m = sent.value
        s, zero = m.settings, len(m.known)
        effect = np.vstack([m.effect, np.zeros((1, len(m.codes)), np.float32)])
        memory: dict[str, int] = dict(m.known)
        more: list[np.ndarray] = []
        codes = np.array(m.codes, object)
        if not len(codes):
            return

        def lookup(w: str) -> int:
            """Row of an unknown word: the mean of its n-grams where enough of them are trained; else none."""
            parts = features(w, s.buckets)[1:]
            at = -1
            if len(parts) >= 3:
                hit = m.trained[parts]
                if hit.mean() >= s.familiar:
                    at = zero + 1 + len(more)
                    more.append(m.table[np.array(parts)[hit]].mean(0))
            if len(memory) < 300_000:
                memory[w] = at
            return at

        for b in batches:
            ids = b.column(0)
            name, desc, tags = (b.column(i).to_pylist() for i in (1, 2, 3))
            row, col = [], []
            for i in range(len(name)):
                t = [at for w in tokens(name[i], desc[i], tags[i]) if (at := memory[w] if w in memory else lookup(w)) >= 0]
                row.append(len(t))
                col += t
            full = np.vstack([effect, *more]) if more else effect
            n = np.array(row)
            total = np.zeros((len(n), len(codes)), np.float32)
            some = n > 0
            if some.any():
                start = (np.cumsum(n) - n)[some]
                total[some] = np.add.reduceat(full[np.array(col)], start, axis=0) / n[some, None]
            p = 1 / (1 + np.exp(-(total + m.bias)))
            p[~some] = 0
            r, c = np.nonzero(p >= s.at_least)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(codes[c], pa.string()), pa.array(p[r, c].astype(np.float64))], ["id", "subject_code", "probability"])
            if len(more) > 50_000:
                memory, more = dict(m.known), []

    return records.select("id", "dataset_name", "dataset_desc", "tags").mapInArrow(run, "id string, subject_code string, probability double")


def subjects(records: DataFrame, labels: DataFrame, areas: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(id, subject_code, probability) of every record. Without labels or areas there are no rows."""
    return score(records, train(records, labels, areas, settings))
