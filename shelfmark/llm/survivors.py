"""Best representative of each duplicate group: token-level consensus.

The values of a group are aligned progressively, weighted tokens vote per column, and every value is held against the
consensus: how far it is from it, and whether it is damaged (cut off where the consensus goes on, or wrongly decoded).
The consensus of a large group is built in blocks whose profiles are merged, so no group is gathered in one task.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import informative, strip
from shelfmark.session import stored

FIELDS = ("dataset_name", "dataset_desc", "dataset_url", "source")
#: Fields whose values can be damaged; True: text of sentences, which end in a sign.
TEXTS = {"dataset_name": False, "dataset_desc": True}
#: Distinct values aligned in one block; columns in a row that tell where agreement ends; tokens of an agreed end whose lack makes a whole sentence's end a cut.
BLOCK, FIRM, LACKING = 256, 5, 3
HOLE = "\ue000"
TOKEN = re.compile(rf"[\u3040-\u30ff\u3400-\u9fff]|(?:[^\W_\u3040-\u30ff\u3400-\u9fff]|{HOLE})+")
MARKUP = re.compile(r"<[^>]*>")
LOST = "\ufffd"
#: UTF-8 read as Latin-1 or Windows-1252: a lead byte and what follows it.
MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf]+|\u00e2\u20ac[\u02dc\u2122\u0153\u017e\u0080-\u00bf]|\u00c3[\u0080-\u00bf\u0152-\u2122]")
ELLIPSIS = re.compile(r"(\.\.\.|…)\s*$")
SENTENCE_END = re.compile(r"""[.!?。！？．;:)\]）」』"'”’]\s*$""")
OPEN, CLOSE = re.compile(r"[(（]"), re.compile(r"[)）]")


def repaired(value: str) -> str:
    """The value without markup, and read as UTF-8 where that was missed."""
    text = MARKUP.sub("", value)
    if MISREAD.search(text):
        for code in ("latin-1", "cp1252"):
            try:
                return text.encode(code).decode("utf-8", "replace")
            except UnicodeEncodeError:
                continue
    return text


@lru_cache(4096)
def tokens(value: str) -> tuple[str, ...]:
    """Lower-case words (single letters of scripts without blanks); a lost letter stays in its word as HOLE."""
    text = unicodedata.normalize("NFKC", repaired(ELLIPSIS.sub("", value))).lower().replace(LOST, HOLE)
    return tuple(TOKEN.findall(text))


def marked(value: str, sentences: bool = False) -> bool:
    """Damage that shows in the value itself: lost or misread letters, an ellipsis at the end, in a name a bracket left open."""
    text = MARKUP.sub("", value)
    if LOST in text or MISREAD.search(text) or ELLIPSIS.search(text):
        return True
    return not sentences and len(OPEN.findall(text)) > len(CLOSE.findall(text))


def doubtful(value: str, field: str) -> bool:
    """Values whose votes count less: marked ones, and descriptions that stop within a sentence."""
    return field in TEXTS and (marked(value, TEXTS[field]) or (TEXTS[field] and not SENTENCE_END.search(MARKUP.sub("", value))))


def same(a: str, b: str) -> bool:
    """Equal tokens; a lost letter stands for any."""
    if a == b:
        return True
    if HOLE in a or HOLE in b:
        return len(a) == len(b) and all(x == y or HOLE in (x, y) for x, y in zip(a, b))
    return False


def fits(column: str, value: tuple[str, ...], j: int) -> bool:
    """Whether token j of a value agrees with a column's; the last one may be cut off."""
    return same(column, value[j]) or (j == len(value) - 1 and column.startswith(value[j]))


def align(columns: list[str], value: tuple[str, ...]) -> list[tuple[int, int]]:
    """(column, token) pairs in order, -1 for a gap: a global alignment with unit costs and free gaps after the value's end."""
    n, m = len(columns), len(value)
    head = 0
    while head < min(n, m) and same(columns[head], value[head]):
        head += 1
    tail = 0
    while tail < min(n, m) - head and same(columns[n - 1 - tail], value[m - 1 - tail]):
        tail += 1
    a, b = columns[head : n - tail], value[head : m - tail]
    out = [(i, i) for i in range(head)]
    if a and b:
        cost = np.zeros((len(b) + 1, len(a) + 1), np.int32)
        step = np.arange(len(a) + 1, dtype=np.int32)
        cost[0] = step
        for j in range(1, len(b) + 1):
            differ = np.fromiter((not fits(x, value, head + j - 1) for x in a), np.int32, len(a))
            row = np.minimum(cost[j - 1] + 1, np.r_[cost[j - 1][0] + 1, cost[j - 1][:-1] + 2 * differ])
            cost[j] = np.minimum.accumulate(row - step) + step
        i, j, mid = len(a), len(b), []
        while i or j:
            if i and j and cost[j, i] == cost[j - 1, i - 1] + (0 if fits(a[i - 1], value, head + j - 1) else 2):
                i, j = i - 1, j - 1
                mid.append((head + i, head + j))
            elif i and cost[j, i] == cost[j, i - 1] + 1:
                i -= 1
                mid.append((head + i, -1))
            else:
                j -= 1
                mid.append((-1, head + j))
        out += mid[::-1]
    else:
        out += [(head + i, -1) for i in range(len(a))] + [(-1, head + j) for j in range(len(b))]
    return out + [(n - tail + i, m - tail + i) for i in range(tail)]


def consensus(values: list[tuple[tuple[str, ...], float]]) -> list[str]:
    """The tokens that win their columns' votes; see ``agreement``."""
    return agreement([(t, w, 1) for t, w in values])[0]


def agreement(values: list[tuple[tuple[str, ...], float, int]]) -> tuple[list[str], int]:
    """(the tokens that win their columns' votes, how many of them, from the first, are firm).

    ``values``: (tokens, weight, records); taken by weight, then length, then text. A value doesn't vote on columns after
    its last token: one that was cut off can't outvote the rest of the others. A column is agreed on if two records or
    more, and two thirds of all, have its token; the firm part ends with the last such column before most of FIRM in a
    row are not, so that slips don't end it but different continuations do.
    """
    values = sorted(values, key=lambda x: (-x[1], -len(x[0]), x[0]))
    profile: list[dict[str, tuple[float, int]]] = []
    passed: list[float] = []
    before, met = 0.0, 0
    leader = lambda column: max(column, key=lambda t: (column[t][0], t))
    for tok, weight, records in values:
        path = align([leader(c) for c in profile], tok)
        last = max((k for k, (_, j) in enumerate(path) if j >= 0), default=-1)
        grown, silent = [], []
        for k, (i, j) in enumerate(path):
            column, gaps = (profile[i], passed[i]) if i >= 0 else ({}, before)
            if j >= 0:
                t = next((x for x in column if fits(x, tok, j)), tok[j])
                if HOLE in t and HOLE not in tok[j]:
                    column[tok[j]] = column.pop(t)
                    t = tok[j]
                w, n = column.get(t, (0.0, 0))
                column[t] = (w + weight, n + records)
            elif k < last:
                gaps += weight
            grown.append(column)
            silent.append(gaps)
        profile, passed = grown, silent
        before += weight
        met += records
    won, agreed = [], []
    for column, gaps in zip(profile, passed):
        t = leader(column)
        if column[t][0] >= gaps or sum(w for w, _ in column.values()) > gaps:
            won.append(t)
            agreed.append(column[t][1] >= 2 and 3 * column[t][1] >= 2 * met)
    firm = 0
    for k, ok in enumerate(agreed):
        recent = agreed[max(0, k + 1 - FIRM) : k + 1]
        if 2 * sum(recent) < len(recent):
            break
        firm = k + 1 if ok else firm
    return won, firm


def verdict(value: str, agreed: list[str], field: str, firm: int = 0) -> tuple[bool, int]:
    """(damaged, distance): tokens that differ from the consensus, and whether the value is cut off or wrongly decoded.

    A name is cut off where the consensus goes on, in the word or after it. So is a description that ends within a word
    of the consensus, or well before the end of its firm part; one that stops without the sign of a sentence is, too, unless
    all the consensus is firm and ends there with it. A description that agrees with little of the consensus is judged by its
    own end alone.
    """
    tok = tokens(value)
    path = align(agreed, tok)
    distance = sum(1 for i, j in path if i < 0 or j < 0 or not same(agreed[i], tok[j]))
    if field not in TEXTS:
        return False, distance
    if marked(value, TEXTS[field]):
        return True, distance
    if TEXTS[field]:
        ended = bool(SENTENCE_END.search(MARKUP.sub("", value)))
        own = sum(1 for i, j in path if j >= 0 and (i < 0 or not fits(agreed[i], tok, j)))
        if not tok or 4 * own > len(tok):
            return not ended, distance
        end = 1 + max((i for i, j in path if j >= 0), default=-1)
        here = next((i for i, j in path if j == len(tok) - 1), -1)
        cut_word = here >= 0 and len(tok[-1]) < len(agreed[here]) and same(tok[-1], agreed[here][: len(tok[-1])])
        if ended:
            return end + LACKING <= firm, distance
        return cut_word or end < len(agreed) or firm < len(agreed), distance
    damaged = False
    if tok and len(tok) <= len(agreed) and all(same(x, y) for x, y in zip(tok[:-1], agreed)):
        here, whole = tok[-1], agreed[len(tok) - 1]
        damaged = (len(here) < len(whole) and same(here, whole[: len(here)])) or (same(here, whole) and len(tok) < len(agreed))
    return damaged, distance


def _by_group(batches, of: int):
    """Consecutive rows with equal first ``of`` columns, as (key, rows)."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:of] != now:
                if rows:
                    yield now, rows
                now, rows = r[:of], []
            rows.append(r[of:])
    if rows:
        yield now, rows


def _build(batches):
    """(group, field, block, value, weight, records, firm) sorted -> (group, field, value, weight, records, firm): each block's consensus, its tokens joined by blanks."""
    names = ("group", "field", "value", "weight", "records", "firm")
    out = []
    for (group, field, _), rows in _by_group(batches, 3):
        votes: dict[tuple[str, ...], list] = {}
        for value, weight, records, _ in rows:
            t = tokens(value)
            mine = votes.setdefault(t, [0.0, 0])
            mine[0] += weight * (0.25 if doubtful(value, field) else 1.0)
            mine[1] += records
        won, firm = agreement([(t, w, n) for t, (w, n) in votes.items()])
        if len(rows) == 1 and rows[0][3] is not None:
            firm = rows[0][3]  # a group that was whole a level before
        out.append((group, field, " ".join(won), float(sum(w for w, _ in votes.values())), sum(n for _, n in votes.values()), firm))
        if len(out) >= 2000:
            yield _batch(out, names)
            out = []
    if out:
        yield _batch(out, names)


def _batch(rows, names):
    kinds = {"weight": pa.float64(), "records": pa.int64(), "damaged": pa.bool_(), "distance": pa.int32(), "firm": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], list(names))


def _judge(batches):
    """(group, field, value, agreed, firm) -> with damaged and distance."""
    for b in batches:
        out, seen = [], {}
        for group, field, value, agreed, firm in zip(*(c.to_pylist() for c in b.columns)):
            k = (group, field)
            if k not in seen:
                seen = {k: (agreed or "").split()}
            out.append((group, field, value, *verdict(value, seen[k], field, firm)))
        yield _batch(out, ("group", "field", "value", "damaged", "distance"))


def field_values(records: DataFrame) -> DataFrame:
    """(group, field, value, id, source, harvested_at): the values that tell something, of groups of two or more records."""
    members = records.where(F.col("canonical_id").isNotNull())
    sizes = members.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("canonical_id")
    members = members.join(sizes, "canonical_id")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS)))
    x = members.select(F.col("canonical_id").alias("group"), "id", "source", "harvested_at", each.alias("x")).select("group", "x.field", "x.value", "id", "source", "harvested_at")
    return x.where(informative(F.col("value")))


def judged(values: DataFrame) -> DataFrame:
    """(group, field, value, damaged, distance) of every distinct value, held against its group's consensus.

    Groups of up to BLOCK distinct values are aligned at once. Larger ones are dealt to blocks by a hash of the value, and
    the blocks' consensus texts aligned in turn, level by level, so that no task gathers a group.
    """
    votes = values.groupBy("group", "field", "value").agg(F.count(F.lit(1)).alias("records"))
    level = votes.withColumns({"weight": F.col("records").cast("double"), "firm": F.lit(None).cast("int")})
    largest = level.groupBy("group", "field").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        counts = level.groupBy("group", "field").agg(F.count(F.lit(1)).alias("_n"))
        placed = level.join(counts, ["group", "field"]).withColumn("block", F.pmod(F.xxhash64("value"), F.ceil(F.col("_n") / BLOCK)).cast("string"))
        large = largest > BLOCK
        ready = placed.select("group", "field", "block", "value", "weight", "records", "firm")
        ready = (ready.repartition("group", "field", "block") if large else ready).sortWithinPartitions("group", "field", "block", "value")
        level = ready.mapInArrow(_build, "group string, field string, value string, weight double, records bigint, firm int")
        if not large:
            break
        level = stored(level)
        largest = -(-largest // BLOCK)  # as many blocks as the largest group had
    agreed = level.select("group", "field", F.col("value").alias("agreed"), "firm")
    x = votes.select("group", "field", "value").join(agreed, ["group", "field"]).sortWithinPartitions("group", "field")
    return x.select("group", "field", "value", "agreed", "firm").mapInArrow(_judge, "group string, field string, value string, damaged boolean, distance int")


def hidden_sources(status: DataFrame) -> DataFrame:
    """(k): lower-case sources whose application_visibility is 0 in some row."""
    return status.where("application_visibility = 0").select(F.lower(strip(F.col("ext_host_name"))).alias("k")).where("k is not null").distinct()


def survivors(records: DataFrame, status: DataFrame) -> DataFrame:
    """(group, field, id, value, damaged, distance, nearest): the surviving record of every field of every group.

    Values that tell nothing never survive; if no member's value tells anything the field has no row. Undamaged values
    go before damaged ones (names and descriptions), then records whose source isn't hidden, then the later
    harvested_at (null last), then the smaller id. nearest is the id whose value is closest to the consensus (ties: the
    same order). Groups are those of two or more rows with one non-null canonical_id.
    """
    values = stored(field_values(records))  # read for the votes, the consensus and the order
    hidden = hidden_sources(status).withColumn("hidden", F.lit(1))
    x = values.join(judged(values), ["group", "field", "value"]).join(hidden, F.lower(strip(F.col("source"))) == F.col("k"), "left")
    order = [F.coalesce("hidden", F.lit(0)), -F.coalesce(F.unix_micros(F.col("harvested_at").cast("timestamp")), F.lit(-(2**62))), F.col("id")]
    best = F.min(F.struct(F.col("damaged"), *(o.alias(f"o{i}") for i, o in enumerate(order)), F.col("value"), F.col("distance"))).alias("b")
    near = F.min(F.struct(F.col("distance"), F.col("damaged"), *(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("c")
    return x.groupBy("group", "field").agg(best, near).select("group", "field", F.col("b.o2").alias("id"), "b.value", "b.damaged", "b.distance", F.col("c.o2").alias("nearest"))
