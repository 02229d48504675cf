"""Outside services behind plain callables, with deterministic defaults that need no network.

A prober tells of each URL how its requests ended, an encoder turns texts into vectors, a chooser picks a record's
final tags. Installations give their own; the defaults make every pipeline run, and test, offline.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (texts) -> one row per text.
Encoder = Callable[[list[str]], np.ndarray]
#: (name, description, candidates, how many) -> (chosen tags, new tags)
Chooser = Callable[[str, str, list[str], int], tuple[list[str], list[str]]]
#: (method, url, seconds) -> status of 'HEAD' or 'GET', or the title of 'RENDER'; raises where nothing answers.
Transport = Callable[[str, str, float], int | str]
#: (prompt) -> the model's answer.
Ask = Callable[[str], str]
PROBE = "head_status array<int>, get_status int, secondary_status int, title string"


def recorded_probe(urls: DataFrame) -> DataFrame:
    """A stand-in prober: outcomes drawn from the URL's MD5, nine in ten alive. ``urls`` has url; adds the columns of PROBE.

    head_status holds the answers of the HEAD attempts in order (null: it raised); get_status is the GET after all of
    them raised; secondary_status that of the second look-up; title the rendered page's.
    """
    d = F.conv(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 4), 16, 10).cast("int") % 100
    head = F.when(d < 80, F.array(F.lit(200))).when(d < 84, F.array(F.lit(301))).when(d < 90, F.array(F.lit(404))).when(d < 93, F.array(F.lit(None).cast("int"), F.lit(200))).otherwise(F.array(F.lit(None).cast("int"), F.lit(None).cast("int")))
    get = F.when((d >= 93) & (d < 97), 200)
    return urls.select("*", head.alias("head_status"), get.cast("int").alias("get_status"), F.when(d % 7 != 0, 200).otherwise(404).alias("secondary_status"), F.when(d < 92, "page").otherwise(" ").alias("title"))


def http_transport(method: str, url: str, seconds: float) -> int | str:
    """HEAD and GET by the standard library; pages aren't rendered."""
    if method == "RENDER":
        raise NotImplementedError("give a transport that renders pages")  # by_browser then finds no title
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method=method), timeout=seconds) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code


def probing(kind, second, transport: Transport = http_transport, retry: int = 1, seconds: float = 5.0, at_once: int = 16) -> Callable[[DataFrame], DataFrame]:
    """A prober that asks: HEAD up to ``retry`` + 1 times until one answers, GET if all raised, then what the policy needs.

    kind and second are columns of the URL (``monitor.policy`` and the second address); addresses of 'api' sites get the
    second look-up after a 200, those of 'browser' sites are rendered. ``at_once`` addresses of a task are asked at a time.
    """

    def tried(method: str, url: str):
        try:
            return transport(method, url, seconds)
        except Exception:  # noqa: BLE001 - whatever a request does, it gave no answer
            return None

    def ask(row):
        url, how, other = row
        if not url:
            return [], None, None, None
        heads: list[int | None] = []
        while len(heads) <= retry and (not heads or heads[-1] is None):
            heads.append(tried("HEAD", url))
        get = tried("GET", url) if heads[-1] is None else None
        first = heads[-1] if heads[-1] is not None else get
        return heads, get, tried("GET", other) if how == "api" and other and first == 200 else None, tried("RENDER", url) if how == "browser" else None

    def run(urls: DataFrame) -> DataFrame:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields]

        def batch(parts):
            with ThreadPoolExecutor(at_once) as pool:
                for p in parts:
                    got = list(pool.map(ask, zip(p["url"], p["_kind"], p["_second"])))
                    out = p.drop(columns=["_kind", "_second"])
                    for i, name in enumerate(("head_status", "get_status", "secondary_status", "title")):
                        values = pd.Series([g[i] for g in got], index=out.index, dtype=object)
                        out[name] = values.astype("Int32") if name in ("get_status", "secondary_status") else values
                    yield out

        return urls.select("*", kind.alias("_kind"), second.alias("_second")).mapInPandas(batch, ", ".join([*fields, PROBE]))

    return run


def selection_text(name: str | None, desc: str | None, found: list[str], k: int, chars: int) -> str:
    """The question to a language model for a record's tags, as ``tags.selection_prompt`` words it."""
    ask = f'Pick the {k} tags that best name the topic of this dataset. Prefer the candidates; if none fits, propose a general term.\nAnswer with JSON only: {{"tags": [...], "new_tags": [...]}}\n\n'
    return f"{ask}Name: {name or ''}\nDescription: {(desc or '')[:chars]}\nCandidates: {', '.join(found)}"


def asking(ask: Ask, chars: int = 500) -> Chooser:
    """A chooser that puts the question to a model and reads its JSON answer; an answer of another shape raises, so the first candidates are taken."""

    def choose(name: str, desc: str, candidates: list[str], k: int) -> tuple[list[str], list[str]]:
        said = json.loads(ask(selection_text(name, desc, candidates, k, chars)))
        lists = [said.get("tags", []), said.get("new_tags", [])]
        if any(not isinstance(x, list) or not all(isinstance(t, str) for t in x) for x in lists):
            raise ValueError("tags and new_tags have to be lists of texts")
        return lists[0][:k], lists[1]

    return choose


def hashing_encoder(texts: Iterable[str], dimensions: int = 64) -> np.ndarray:
    """A stand-in encoder: the sum of one fixed random vector per word, of length 1 (zeros for no word)."""
    memory: dict[str, np.ndarray] = {}
    out = []
    for t in texts:
        v = np.zeros(dimensions)
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            if w not in memory:
                memory[w] = np.random.default_rng(zlib.crc32(w.encode())).normal(size=dimensions)
            v += memory[w]
        out.append(v / (np.linalg.norm(v) + 1e-9))
    return np.array(out).reshape(-1, dimensions)


def first_candidates(name: str, desc: str, candidates: list[str], k: int) -> tuple[list[str], list[str]]:
    """The chooser for when no model answers: the first candidates, nothing new."""
    return candidates[:k], []


def encoded(texts: DataFrame, key: str, text: str, encoder: Encoder = hashing_encoder) -> DataFrame:
    """(key, embedding): each text's unit vector, batch by batch."""

    def run(parts):
        for p in parts:
            v = np.asarray(encoder(p["_text"].fillna("").tolist()), np.float64)
            v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9) if len(v) else v
            yield pd.DataFrame({key: p[key], "embedding": list(v.astype(np.float32))})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")
