"""Repeated lines and passages: the earliest ranked occurrence of a unit stays, the others go.

A text is its words (runs of anything but white space, A-Z in lower case).  Two kinds of
units are digested (96 bits) and grouped over the whole corpus: whole lines (or
paragraphs) of ``LINE_WORDS`` words or more, and runs of ``WINDOW`` words at any place, so
that a passage is found in the middle of lines and across them.  A unit is repeated if the
same words stand earlier as such a unit, by (doc_id, row key, position); all its words go.
A run that overlaps its own earliest occurrence loses only the words behind that, so every
word that goes still stands in an earlier text or place.

Not every run is dealt.  Of the GRAM-word runs in a window the one of the smallest hash is
its anchor; it depends on the window's words alone, so a repeated window has an anchor
that occurs twice.  Anchors (about one in 13 words) are counted first, and only windows
whose anchor recurs are digested and compared.  Documents of equal text are not compared
by windows: the first stays, of the others of WINDOW words or more everything goes.
Frequencies and earliest places are aggregates with map-side combining, joined back by
joins whose hot side Spark can split.

Removed spans are offsets of the original text in code points, end exclusive.  Of the white
space around a span the side with more line breaks stays, none at the ends of the text.
Null texts have no words and stay null.  Rows equal in id and text are one document and
share one result; null ids rank last.  Other columns travel in the struct ``row``.
"""

from __future__ import annotations

import functools
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .common import cut, prepare, release, row_key, scratch, slices, table, utf8_buffers

WINDOW = 50
GRAM = 25
LINE_WORDS = 5
#: Line breaks without other words between them that end a unit.
BREAKS = {"line": 1, "paragraph": 2}
#: Bytes of text whose words are hashed at once.
SLICE = 1 << 18
LANES = [(0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _spaces() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


@functools.cache
def _bytes(lane: int) -> np.ndarray:
    """A number for each byte: A-Z have those of a-z, white space has 0."""
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += 32
    return np.where(_spaces(), np.uint64(0), _mix((low + np.uint64(1)) * np.uint64(LANES[lane][0])))


@functools.lru_cache(maxsize=4)
def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_table(base, max(2 * SLICE, 1 << int(n).bit_length()))


class Words:
    """The words of some texts: their texts, and digests of runs of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lanes: int = 2):
        n = len(data)
        space = _spaces()[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[True], space[:-1]]) if n else space
        after = np.concatenate([space[1:], [True]]) if n else space
        self.starts = np.flatnonzero(~space & (before | edge[:n]))
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(offsets)))
        self.sums = []
        for lane in range(lanes):
            base, step = LANES[lane]
            power, inverse = _powers(base, n)
            words = np.add.reduceat(_bytes(lane)[data] * power[:n], self.starts) * inverse[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
            power, _ = _powers(step, len(words))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words) * power[: len(words)], dtype=np.uint64)]))

    def digests(self, lane: int, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inverse = _powers(LANES[lane][1], len(self.starts))
        return _mix((self.sums[lane][end] - self.sums[lane][at]) * inverse[at] + (end - at).astype(np.uint64))

    def runs(self, n: int) -> np.ndarray:
        """Whether n words of one text begin at each word."""
        out = np.zeros(len(self.text), bool)
        if len(out) >= n:
            out[: len(out) - n + 1] = self.text[: len(out) - n + 1] == self.text[n - 1 :]
        return out

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the run of gram words at each word, of the anchor of the window there, and which words begin an anchor."""
        whole, short = self.runs(window), np.flatnonzero(self.runs(gram))
        grams = np.full(len(self.text), ~np.uint64(0))
        grams[short] = self.digests(0, short, short + gram)
        width = window - gram + 1
        least = np.where(whole, _slide(grams, width, np.minimum, ~np.uint64(0)), np.uint64(0))
        chosen = _slide(least[::-1], width, np.maximum, np.uint64(0))[::-1]
        picked = np.zeros(len(grams), bool)
        picked[short] = grams[short] == chosen[short]
        return grams, np.where(whole, least, ~np.uint64(0)), picked


def _slide(x: np.ndarray, width: int, pick, rest) -> np.ndarray:
    """pick over x[i : i + width] for each i, with rest behind the end."""
    x, n, done = np.concatenate([x, np.full(width, rest)]), len(x), 1
    while done < width:
        step = min(done, width - done)
        x[: len(x) - step] = pick(x[: len(x) - step], x[step:])
        done += step
    return x[:n]


def _parts(column):
    """(first row, data, offsets) of slices of a string column."""
    data, offsets = utf8_buffers(column)
    for a, b in slices(np.diff(offsets), SLICE):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _anchor_rows(window: int, gram: int):
    def rows(batches):

        for batch in batches:
            tag = batch.column("tag").to_numpy(zero_copy_only=False)
            for row, data, offsets in _parts(batch.column("source")):
                w = Words(data, offsets, 1)
                grams, _, picked = w.anchors(window, gram)
                at = np.flatnonzero(picked)
                order = np.lexsort((grams[at], w.text[at]))
                text, anchor = w.text[at][order], grams[at][order]
                new = np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])[: len(text)]
                head = np.flatnonzero(new)
                twice = np.diff(np.concatenate([head, [len(text)]])) > 1
                yield pa.RecordBatch.from_arrays([pa.array(_signed(anchor[head])), pa.array(tag[row + text[head]]), pa.array(twice)], names=["anchor", "tag", "twice"])

    return rows


def _units(batch, row, text, w, at, end):

    take = pa.array(row + text)
    first = w.first[text]
    columns = [_signed(w.digests(0, at, end)), (w.digests(1, at, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)]
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, columns), batch.column("id").take(take), batch.column("key").take(take), pa.array((at - first).astype(np.int32)), pa.array((end - at).astype(np.int32))],
        names=["high", "low", "id", "key", "at", "n"],
    )


def _window_rows(window: int, gram: int):
    def rows(batches):
        for batch in batches:
            wanted = batch.column("anchors")
            for row, data, offsets in _parts(batch.column("source")):
                w = Words(data, offsets)
                _, least, _ = w.anchors(window, gram)
                whole, found = w.runs(window), []
                for i in range(len(offsets) - 1):
                    a, b = w.first[i], w.first[i + 1]
                    some = np.sort(wanted[row + i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    mine = least[a:b]
                    place = np.minimum(np.searchsorted(some, mine), len(some) - 1)
                    found.append(a + np.flatnonzero((some[place] == mine) & whole[a:b]))
                at = np.concatenate(found)
                yield _units(batch, row, w.text[at], w, at, at + window)

    return rows


def _line_rows(least: int, breaks: int):
    def rows(batches):
        for batch in batches:
            for row, data, offsets in _parts(batch.column("source")):
                w = Words(data, offsets)
                if not len(w.starts):
                    continue
                before = np.concatenate([[0], np.cumsum(data == 10)])[w.starts]
                head = np.flatnonzero(np.concatenate([[True], (before[1:] - before[:-1] >= breaks) | (w.text[1:] != w.text[:-1])]))
                end = np.concatenate([head[1:], [len(w.starts)]])
                long = end - head >= least
                yield _units(batch, row, w.text[head[long]], w, head[long], end[long])

    return rows


def _stored(df: DataFrame) -> DataFrame:
    """``df`` cut, and what it took on disk gone: a second collection frees what the first uncovered."""
    df = cut(df)
    _free(df.sparkSession)
    return df


def _free(spark: SparkSession) -> None:
    for _ in range(2):
        release(spark)
        time.sleep(0.4)


def _repeated(units: DataFrame) -> DataFrame:
    """key and the word ranges of the units that stand earlier too.

    The units are written once: counting and joining them read the file, not the texts, and
    what was shuffled to find them is gone by then.
    """
    spark, path = units.sparkSession, scratch(units.sparkSession)
    units.write.parquet(path)
    del units
    _free(spark)
    gone = _stored(_ranges(_later(spark.read.parquet(path))))
    files.remove(spark, path)
    return gone


def _later(units: DataFrame) -> DataFrame:
    """key and word range of the units that stand earlier too."""
    units = units.withColumn("nameless", F.col("id").isNull())
    first = units.groupBy("high", "low").agg(F.count("*").alias("times"), F.min(F.struct("nameless", "id", "key", "at")).alias("kept")).filter("times > 1")
    # Joined on another form of the digest, so that both sides are shuffled for the join and Spark can split a hot unit's places.
    first = first.select(F.struct("high", "low").alias("unit"), F.col("kept.key").alias("kept_key"), F.col("kept.at").alias("kept_at"))
    gone = units.select(F.struct("high", "low").alias("unit"), "key", "at", "n").join(first, "unit").filter("key <> kept_key or at <> kept_at")
    start = F.when(F.col("key") == F.col("kept_key"), F.greatest(F.col("at"), F.col("kept_at") + F.col("n"))).otherwise(F.col("at"))
    return gone.select("key", start.alias("start"), (F.col("at") + F.col("n")).alias("end"))


def _ranges(gone: DataFrame) -> DataFrame:
    return gone.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("gone"))


def _rebuild(text: str, gone: list[tuple[int, int]], words) -> tuple[list[dict], str]:
    """Removed spans, neighbours joined, and what stays."""
    spans = [m.span() for m in words.finditer(text)]
    runs: list[list[int]] = []
    for a, b in sorted(gone):
        b = min(b, len(spans))
        if a >= b:
            continue
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    removed, kept, at = [], [], 0
    for a, b in runs:
        start, end = spans[a][0], spans[b - 1][1]
        removed.append({"start": start, "end": end, "words": b - a})
        left = spans[a - 1][1] if a else 0
        right = spans[b][0] if b < len(spans) else len(text)
        gaps = [text[left:start], text[end:right]]
        gap = "" if not a or b == len(spans) else max(gaps, key=lambda g: g.count("\n"))
        kept += [text[at:left], gap]
        at = right
    return removed, "".join(kept) + text[at:]


def remove_repeats(docs: DataFrame, unit: str = "line", window: int = WINDOW, gram: int = GRAM, min_words: int = LINE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the input's columns), removed (start, end and words of each span) and text of each row."""
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("source"))
    # 96 bits name a document, as they do a unit: they are most of what is shuffled.
    d = d.withColumn("key", F.substring(F.unhex(row_key(F.col("id"), F.col("source"))), 1, 12))
    texts = d.filter("source is not null")
    schema = f"high long, low int, id {d.schema['id'].dataType.simpleString()}, key binary, at int, n int"

    tagged = texts.withColumn("tag", F.xxhash64("source"))
    seen = tagged.select("tag", "source").mapInArrow(_anchor_rows(window, gram), "anchor long, tag long, twice boolean")
    again = seen.groupBy("anchor").agg(F.min("tag").alias("a"), F.max("tag").alias("b"), F.max("twice").alias("twice")).filter("a <> b or twice")
    wanted = seen.select("anchor", "tag").join(again.select("anchor"), "anchor").groupBy("tag").agg(F.collect_set("anchor").alias("anchors"))
    named = tagged.select(F.unhex(F.md5("source")).alias("digest"), "tag", F.col("id").isNull().alias("nameless"), "id", "key")
    firsts = named.groupBy("digest", "tag").agg(F.min(F.struct("nameless", "id", "key")).alias("kept"), F.count("*").alias("times"))
    wanted = _stored(firsts.select("tag", F.col("kept.key").alias("key")).join(wanted, "tag").select("key", "anchors"))

    near = texts.select("id", "key", "source").join(wanted, "key").select("id", "key", "source", "anchors")
    gone = _repeated(near.mapInArrow(_window_rows(window, gram), schema))
    lines = _repeated(texts.select("id", "key", "source").mapInArrow(_line_rows(min_words, BREAKS[unit]), schema))

    copies = named.join(firsts.filter("times > 1").select("digest", "kept"), "digest").filter("key <> kept.key").select("key").distinct()
    whole = copies.select("key", F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))).alias("gone"))
    gone = gone.unionByName(lines).unionByName(whole).groupBy("key").agg(F.flatten(F.collect_list("gone")).alias("gone"))


    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])

    @F.arrow_udf("struct<removed: array<struct<start: bigint, end: bigint, words: bigint>>, text: string>")
    def rebuild(source: pa.Array, gone: pa.Array) -> pa.Array:
        import re

        words, removed, kept = re.compile(r"[^ \t\n\x0B\f\r]+"), [], []
        for text, out in zip(source, gone, strict=True):
            if not out.is_valid:  # nothing goes, and the text was not sent
                removed.append([]), kept.append(None)
                continue
            text, out = text.as_py(), [(g["start"], g["end"]) for g in out.as_py()]
            if (-1, -1) in out:  # a copy, which goes if it is long enough for a window
                out = [g for g in out if g != (-1, -1)]
                n = sum(1 for _ in words.finditer(text))
                out += [(0, n)] * (n >= window)
            spans, rest = _rebuild(text, out, words) if out else ([], text)
            removed.append(spans), kept.append(rest)
        return pa.StructArray.from_arrays([pa.array(removed, pa.list_(span)), pa.array(kept, pa.string())], names=["removed", "text"])

    touched = F.when(F.col("gone").isNotNull(), F.col("source"))
    joined = d.join(gone, "key", "left").select("row", "source", rebuild(touched, F.col("gone")).alias("r"))
    return joined.select("row", "r.removed", F.coalesce("r.text", "source").alias("text"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, removed spans, their words, how many have WINDOW words or more, the spans (start:end, comma-joined) and the text that stays."""
    prepare(spark)
    found = remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select(
        "row.doc_id",
        F.size(F.filter("removed", lambda s: s["words"] >= WINDOW)).cast("long").alias("n_passages"),
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["words"]).alias("n_removed_words"),
        spans.alias("removed_spans"),
        "text",
    )


def oracle() -> str:
    """The same rows in DuckDB SQL: a window's digest is built by doubling, so no window is spelt out."""
    space, upper, lower = r"\x20\x09-\x0D", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    doubled = ",\n".join(f"h{2 * k} as (select *, hash(h{k}, lead(h{k}, {k}) over own) as h{2 * k} from h{k} window own as (partition by doc_id order by i))" for k in (1, 2, 4, 8, 16))
    return rf"""
with d as (select doc_id, text, regexp_extract_all(text, '[^{space}]+') as ws, regexp_split_to_array(text, '[^{space}]+') as gs from documents),
h1 as (select doc_id, i, ws[i] as word, gs[i] as gap, len(ws) as n, hash(translate(ws[i], '{upper}', '{lower}')) as h1, translate(ws[i], '{upper}', '{lower}') as low
  from (select *, unnest(range(1, len(ws) + 1)) as i from d)),
{doubled},
p as (select doc_id, i, word, gap, n, low, hash(h32, lead(h16, 32) over own, lead(h2, 48) over own) as h50,
  sum(length(gap)) over own + coalesce(sum(length(word)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start,
  sum(length(gap) - length(replace(gap, chr(10), ''))) over own as line from h32 window own as (partition by doc_id order by i)),
e as (select doc_id, i, min((doc_id, i)) over (partition by h50) as kept from p where i + {WINDOW - 1} <= n),
g as (select doc_id, i, case when kept[1] = doc_id then greatest(i, kept[2] + {WINDOW}) else i end as at from e where kept <> (doc_id, i)),
u as (select doc_id, line, string_agg(low, ' ' order by i) as unit from p group by all having count(*) >= {LINE_WORDS}),
l as (select doc_id, line from (select doc_id, line, row_number() over (partition by unit order by doc_id, line) as k from u) where k > 1),
m as (select p.*, coalesce(min(g.at) over (partition by p.doc_id order by p.i rows between {WINDOW - 1} preceding and current row) <= p.i, false) or l.line is not null as gone
  from p left join g on g.doc_id = p.doc_id and g.i = p.i left join l on l.doc_id = p.doc_id and l.line = p.line),
r as (select *, coalesce(lag(gone) over own, false) as after_gone, i - row_number() over (partition by doc_id, gone order by i) as run from m window own as (partition by doc_id order by i)),
b as (select *, last_value(case when gone and not after_gone then gap end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as left_gap,
  last_value(case when gone and not after_gone then i end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as run_at from r),
s as (select doc_id, run, min(start) as a, max(start + length(word)) as z, count(*) as k from b where gone group by doc_id, run),
t as (select doc_id, string_agg(case when not after_gone then gap when run_at = 1 then ''
  when length(gap) - length(replace(gap, chr(10), '')) > length(left_gap) - length(replace(left_gap, chr(10), '')) then gap else left_gap end || word, '' order by i) as kept,
  max(i) as last from b where not gone group by doc_id),
c as (select doc_id, count(*) filter (k >= {WINDOW}) as n_passages, count(*) as n_removed, sum(k) as n_removed_words, string_agg(a || ':' || z, ',' order by a) as removed_spans from s group by doc_id)
select doc_id, coalesce(n_passages, 0)::bigint as n_passages, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_removed_words, 0)::bigint as n_removed_words, coalesce(removed_spans, '') as removed_spans,
  case when c.doc_id is null then text else coalesce(kept, '') || case when last = len(ws) then gs[len(gs)] else '' end end as text
from d left join c using (doc_id) left join t using (doc_id)"""
