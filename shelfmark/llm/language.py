"""Missing or wrong language labels: hyperdimensional profiles.

Every letter has a random vector of +1 and -1; an n-gram binds the permuted vectors of its letters (product after
rotation by position), words bundle their n-grams, sentences their words, and a language prototype bundles the sentences
of documents labelled with it. A sentence has the language whose prototype is nearest by cosine; the longest stretches
of sentences in one language are the segments of a document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Usual spellings of the languages, in lower case and without region.
NAMES = {
    "en": ("en", "eng", "english", "英语", "英文"),
    "zh": ("zh", "zho", "chi", "chinese", "cn", "cmn", "mandarin", "中文", "汉语", "漢語", "华语", "简体中文", "繁體中文"),
    "de": ("de", "deu", "ger", "german", "deutsch", "德语"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "法语"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian", "西班牙语"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "葡萄牙语"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish", "荷兰语"),
    "ru": ("ru", "rus", "russian", "русский", "俄语"),
    "ja": ("ja", "jpn", "jp", "japanese", "日本語", "日语"),
}
LANGUAGES = tuple(NAMES)
#: Numbers in a vector; documents per language that train the prototypes, and their largest length; words a worker remembers.
DIMENSIONS, TRAIN_DOCUMENTS, TRAIN_CHARS, REMEMBERED = 1024, 200, 20_000, 20_000
#: Weight of a whole word beside each of its three-letter grams; steps and rate of the retraining.
WHOLE, STEPS, RATE = 3, 30, 0.5
#: Rotations of the letters that are kept as tables.
KEPT_TURNS = 100
#: Log-odds per unit of cosine, and those a change of language must bring in.
SCALE, SWITCH = 20.0, 2.0
SEED = 7

CJK = "぀-ヿ㐀-䶿一-鿿ｦ-ﾟ々〆ー"
MARKUP = re.compile(r"<\|[^|>]*\|>|<[^>]*>")
INVISIBLE = re.compile("[​-‏⁠﻿­]")
ADDRESS = re.compile(r"\b(?:https?|ftp)://\S+|\bwww\.\S+|\S+@\S+\.\S+")
BREAK = re.compile(r"""(?<=[.!?])["'”’»)\]）]*\s+|(?<=[。！？])["'”’»)\]」』）]*\s*""")
END = re.compile(r"""[.!?。！？]["'”’»)\]」』）]*$""")
WORD = re.compile(rf"[{CJK}]+|[^\W\d_{CJK}]+")
HAN = re.compile(rf"^[{CJK}]")


def label_of(c: Column) -> Column:
    """The language code a label means in any usual spelling; null if it is missing or names none of the nine."""
    x = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for probe in (x, F.regexp_extract(x, r"^([^-_ (（]+)", 1)):
        for code, names in NAMES.items():
            out = F.coalesce(out, F.when(probe.isin(*names), F.lit(code)))
    return out


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, in order: units that end like one and have words enough.

    Markup, addresses, tables, name and keyword lists are none; null, blank and sentence-free texts have none.
    """
    if not text:
        return []
    text = INVISIBLE.sub("", MARKUP.sub("\n", text)).replace(" ", "\n")
    out = []
    for line in text.splitlines():
        if line.count("|") >= 2:
            continue
        for unit in BREAK.split(line):
            unit = unit.strip()
            if not END.search(unit):
                continue
            words = WORD.findall(without_addresses(unit))
            size = sum(len(w) if HAN.match(w) else 2 for w in words)
            if size < 6:
                continue
            if unit.count(";") >= 2 and unit.count(";") * 3 >= len(words):
                continue
            out.append(unit)
    return out


def without_addresses(unit: str) -> str:
    """The unit without addresses, which are looked for only where a sign of one is."""
    return ADDRESS.sub(" ", unit) if "@" in unit or "//" in unit or "www." in unit else unit


def total(rows: np.ndarray) -> np.ndarray:
    """Sum of rows of +1 and -1 in 16 bits; of more rows than these hold as near as they do."""
    return rows.sum(0, dtype=np.int16) if len(rows) < 15_000 else np.clip(rows.sum(0, dtype=np.int32), -15_000, 15_000).astype(np.int16)


class Space:
    """Vectors of letters, words and sentences, made for many at once."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.d, self.seed = dimensions, seed
        self.row: dict[str, int] = {}
        self.base = np.zeros((0, dimensions), np.int8)
        self.turned: dict[int, np.ndarray] = {}
        self.words: dict[str, int] = {}
        self.vectors = np.zeros((1024, dimensions), np.int16)

    def letters(self, text: str) -> np.ndarray:
        """Row of each letter; new letters get theirs, the same in every worker."""
        new = [c for c in dict.fromkeys(text) if c not in self.row]
        if new:
            drawn = [np.random.default_rng((self.seed, ord(c))).integers(0, 2, self.d, np.int8) * 2 - 1 for c in new]
            self.row.update({c: len(self.row) + i for i, c in enumerate(new)})
            self.base = np.vstack([self.base, np.array(drawn, np.int8)])
            self.turned = {}
        return np.fromiter(map(self.row.__getitem__, text), np.int64, len(text))

    def turn(self, shift: int, rows: np.ndarray) -> np.ndarray:
        """Letters permuted ``shift`` times: rotated. The tables of small shifts are kept."""
        if shift > KEPT_TURNS:
            return np.roll(self.base[rows], shift, axis=1)
        if shift not in self.turned:
            self.turned[shift] = np.roll(self.base, shift, axis=1)
        return self.turned[shift][rows]

    def make(self, words: list[str]) -> np.ndarray:
        """One row per word: its three-letter grams and itself as a whole; of scripts without blanks its letters and pairs."""
        out = np.zeros((len(words), self.d), np.int16)
        han = np.array([bool(HAN.match(w)) for w in words], bool)
        for which, pad, size in ((np.flatnonzero(han), "", 2), (np.flatnonzero(~han), " ", 3)):
            if not len(which):
                continue
            texts = [f"{pad}{words[i]}{pad}" for i in which]
            length = np.array([len(t) for t in texts])
            code = self.letters("".join(texts))
            start = np.cumsum(length) - length
            owner = np.repeat(np.arange(len(texts)), length)
            first = np.flatnonzero(np.arange(len(code)) + size <= (start + length)[owner])
            if len(first):
                grams = self.turn(size - 1, code[first])
                for k in range(1, size):
                    grams = grams * self.turn(size - 1 - k, code[first + k])
                own, at = np.unique(owner[first], return_index=True)
                for i, lo, hi in zip(own.tolist(), at.tolist(), [*at[1:].tolist(), len(first)]):
                    out[which[i]] += total(grams[lo:hi])
            if size == 2:
                for i, lo, n in zip(which.tolist(), start.tolist(), length.tolist()):
                    out[i] += total(self.base[code[lo : lo + n]])
            else:
                whole = np.ones((len(texts), self.d), np.int8)
                for k in range(int(length.max()) - 2):
                    on = np.flatnonzero(length - 2 > k)
                    whole[on] *= self.turn(3 * k + 3, code[start[on] + 1 + k])
                out[which] += WHOLE * whole.astype(np.int16)
        return out

    def rows(self, words: list[str]) -> np.ndarray:
        """Row in ``vectors`` of each word; words not remembered are made together."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.words]
        if len(self.words) + len(fresh) > REMEMBERED:
            self.words, fresh = {}, list(dict.fromkeys(words))
        for lo in range(0, len(fresh), 500):
            part = fresh[lo : lo + 500]
            have = len(self.words)
            while have + len(part) > len(self.vectors):
                self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[have : have + len(part)] = self.make(part)
            self.words.update(zip(part, range(have, have + len(part))))
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def bundle(self, units: list[str]) -> np.ndarray:
        """One row per sentence, of length 1."""
        out = np.zeros((len(units), self.d), np.float32)
        said = [WORD.findall(without_addresses(unit.lower())) for unit in units]
        at, held = 0, 0
        for i in range(len(units) + 1):
            # some thousand words at a time
            if i == len(units) or held > 4000:
                some = [k for k in range(at, i) if said[k]]
                if some:
                    row = self.rows([w for k in some for w in said[k]])
                    lo = 0
                    for k in some:
                        n = len(said[k])
                        # a letter adds at most two to a number, a word three more: short sentences can't overflow
                        kind = np.int16 if 4 * len(units[k]) + 3 * n < 30_000 else np.int32
                        out[k] = self.vectors[row[lo : lo + n]].sum(0, dtype=kind)
                        lo += n
                at, held = i, 0
            if i < len(units):
                held += len(said[i])
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def prototypes(documents: DataFrame, per_language: int = TRAIN_DOCUMENTS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row of length 1 per language, from at most ``per_language`` labelled documents each (a bounded sample, by hash of doc_id).

    Labels may be wrong and documents mixed: after the first bundling, documents whose sentences don't nearly all lie
    nearest to the label are left out, twice. Then sentences the prototypes still get wrong, or only just right, are
    added to the right prototype and taken from the wrong one, a few times over.
    """
    labelled = documents.select("doc_id", "text", label_of(F.col("lang")).alias("code")).where(F.col("code").isNotNull() & F.length("text").between(40, TRAIN_CHARS))
    rank = F.row_number().over(W.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = labelled.withColumn("_rn", rank).where(F.col("_rn") <= per_language).select("code", "text").orderBy("code", "text").toArrow().to_pylist()
    space, empty = Space(dimensions), np.zeros((len(LANGUAGES), dimensions), np.float32)
    units = [(i, LANGUAGES.index(r["code"]), s) for i, r in enumerate(sample) for s in dict.fromkeys(sentences(r["text"]))]
    if not units:
        return empty
    doc, said, vectors = np.array([u[0] for u in units]), np.array([u[1] for u in units]), space.bundle([u[2] for u in units])
    keep = np.ones(len(units), bool)
    for _ in range(3):
        p = unit_rows(np.stack([vectors[keep & (said == k)].sum(0) for k in range(len(LANGUAGES))]))
        right = (vectors @ p.T).argmax(1) == said
        share = np.bincount(doc, right) / np.maximum(np.bincount(doc), 1)
        keep = share[doc] >= 0.75
    if not keep.any():
        return p
    v, y, row = vectors[keep], said[keep], np.arange(int(keep.sum()))
    for _ in range(STEPS):
        cos = v @ p.T
        own = cos[row, y]
        cos[row, y] = -np.inf
        other = cos.argmax(1)
        near = own - cos[row, other] < 0.15
        for k in range(len(LANGUAGES)):
            move = v[near & (y == k)].sum(0) - v[near & (other == k)].sum(0)
            p[k] += RATE * move / max(1, (near & ((y == k) | (other == k))).sum())
        p = unit_rows(p)
    return p


def unit_rows(p: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros (languages without a sentence) stay."""
    norm = np.linalg.norm(p, axis=1, keepdims=True)
    return (p / np.where(norm > 0, norm, 1)).astype(np.float32)


def decode(scores: np.ndarray) -> np.ndarray:
    """The likeliest languages of a document's sentences, given their log-odds, where every change of language costs SWITCH."""
    n = len(scores)
    best, back = scores[0].copy(), np.zeros((n, scores.shape[1]), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back[i] = np.where(stay, np.arange(scores.shape[1]), top)
        best = np.where(stay, best, best[top] - SWITCH) + scores[i]
    out = np.zeros(n, np.int64)
    out[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def segments(documents: DataFrame, protos: np.ndarray) -> DataFrame:
    """(doc_id, segment_no, lang, confidence, sentences, letters, label, share): every stretch of sentences in one language.

    confidence is the mean, weighed by letters, of each sentence's share in a softmax of its cosines; label is what the
    document's label means (null if missing or unknown). Documents without a sentence have no row; repeated rows stay.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "segment_no", "lang", "confidence", "sentences", "letters", "label"]

    def run(batches):
        space, seen = Space(protos.shape[1]), {}
        for b in batches:
            ids, texts, labels = (c.to_pylist() for c in b.columns)
            for at in range(0, len(ids), 200):
                docs = [sentences(t) for t in texts[at : at + 200]]
                fresh = list(dict.fromkeys(s for d in docs for s in d if s not in seen))
                if len(seen) > REMEMBERED:
                    seen, fresh = {}, list(dict.fromkeys(s for d in docs for s in d))
                for k in range(0, len(fresh), 2000):
                    part = fresh[k : k + 2000]
                    odds = SCALE * (space.bundle(part) @ protos.T)
                    odds -= odds.max(1, keepdims=True)
                    odds -= np.log(np.exp(odds).sum(1, keepdims=True))
                    seen.update(zip(part, odds))
                out = []
                for doc, label, units in zip(ids[at : at + 200], labels[at : at + 200], docs):
                    if not units:
                        continue
                    odds = np.stack([seen[s] for s in units])
                    runs: list[list] = []
                    for s, lang, o in zip(units, decode(odds).tolist(), odds):
                        if not runs or runs[-1][0] != lang:
                            runs.append([lang, 0.0, 0, 0])
                        runs[-1][1] += float(np.exp(o[lang])) * len(s)
                        runs[-1][2] += 1
                        runs[-1][3] += len(s)
                    out += [(doc, n, LANGUAGES[lang], total / letters, count, letters, label) for n, (lang, total, count, letters) in enumerate(runs, 1)]
                columns = list(zip(*out)) or [()] * len(names)
                kinds = [b.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = f"doc_id {kind}, segment_no int, lang string, confidence double, sentences int, letters int, label string"
    return documents.select("doc_id", "text", label_of(F.col("lang")).alias("label")).mapInArrow(run, schema)


def mislabelled(parts: DataFrame) -> DataFrame:
    """The segments of documents whose label is missing or names another language, or that hold several languages.

    A document's segments alternate in language, so a second segment means a second language: a semi-join by doc_id of
    the (few) such documents finds the rows of each, wherever they lie.
    """
    wrong = parts.where((F.col("segment_no") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("doc_id").distinct()
    return parts.join(wrong, "doc_id", "left_semi")


def document_languages(parts: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, languages): the language with most letters (ties: alphabetical) of each document with sentences."""
    by = parts.groupBy("doc_id", "lang").agg(F.sum("letters").alias("n"), F.sum(F.col("confidence") * F.col("letters")).alias("c"))
    return by.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), "lang", (F.col("c") / F.col("n")).alias("confidence"))).alias("b"), F.count(F.lit(1)).alias("languages")).select("doc_id", "b.lang", "b.confidence", "languages")
