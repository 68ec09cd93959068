"""Subject areas of documents: bisecting k-means leaves, labelled by discriminative terms, mixed per page.

1. Every page is cut to its own body: lines that end as sentences do, cut into sentences.
2. Document frequencies of all terms, over all documents, give a vocabulary and tf-idf vectors of length 1.
3. Bisecting k-means splits all documents level by level; passes over all documents of a level's nodes
   go on until its centres settle. Only the two starting points of a split come from a bounded
   sample of its node, or, where that is all alike, from its document farthest from the centre.
4. Each leaf's discriminative terms are compared with those of the labelled examples of each subject:
   they give the leaf's mixture of subjects, mostly one, or none.
5. Leaves, cut into one part for each subject of their mixture, are then the components of a mixture of
   sentences: a sentence belongs to the leaf that its terms speak for, by their rates in the leaves, and the
   rates are taken again from the clear sentences. A page's mixture of leaves times the subjects of these gives
   its shares. Subjects enter by the labels of leaves alone: without the tree no page has one.

Documents are kept in chunks of flat arrays, so that a pass over them is a few array operations. What
reaches the driver is bounded by the model: vocabulary, nodes and subjects, never by the corpus.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_shared, materialize, reread, write_shared

#: A term must be in this share of all documents (and in two), and no more than that one: the first bounds the
#: vocabulary, as the mean number of terms of a document divided by it, whatever the corpus. Terms of the labelled examples always count.
LEAST_SHARE, MOST_SHARE = 2e-5, 0.5
#: The share of all documents' spread (squared distance to their centre) under which a node stays a leaf, so that
#: the number of nodes that are split on each level is bounded by its inverse.
LEAST_SPREAD = 0.004
#: A split that lowers its node's spread by a smaller share than this, plus what chance gives a node of few
#: documents, told nothing: its halves are leaves. Where it only split off odd documents, under the last share
#: of the node, the rest is tried again.
LEAST_GAIN, CHANCE, OUTLIERS = 0.02, 6.0, 0.05
#: Documents of a node by which the two starting points of its split are found.
SEED_DOCS = 192
#: The two centres of a node have settled once a pass lowers its spread by no more than this share.
SETTLED = 1e-4
#: Pairs of these from which a split is started.
STARTS = 12
#: A page has a subject from this share of its sentences.
LEAST_MIX = 0.2
#: Evidence (log-ratio) from which a term counts, and from which a sentence speaks for itself; below
#: that, its page must speak for the subject with this share of its evidence.
WEAK, CLEAR, PAGE = 0.9, 1.5, 0.25
#: The weight of a term of one subject, and the times that weights are taken again from the sentences
#: that the weights before made clear, over all documents.
STRONG, REFINEMENTS = 3.0, 3
#: Subjects that may share a term as one of their own.
SHARED = 4
#: A part of a leaf uses a term whose rate there is at least the highest among its subject's, divided by this.
USED = 5
#: Documents in a chunk, and tasks of a pass for each core of the cluster.
CHUNK, TASKS_PER_CORE = 2_000, 4
#: Documents up to which a node's whole subtree is grown in one task, as the passes of small nodes cost more than their work.
LOCAL_DOCS = 30_000
#: Tasks whose sums the driver takes as they are.
TASKS_TO_DRIVER = 64
#: The status of a page that was delivered as asked for.
DELIVERED = 200

_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[.!…。！]\s+")
_ENDS = (".", "!", "?", "…", "。", "！", "？", "»", "”", '"')


#: Letters that UTF-8 read by another charset begins with, and those charsets.
_MISREAD = re.compile("[ÃÂâÄÅĂăĹÎÐÑﾃﾂ窶�]")
_CHARSETS = ("cp1252", "latin-1", "cp932", "cp1250", "iso8859-2")


def reread_line(line: str) -> str:
    """A line whose UTF-8 was read by another charset, read again; any other line as it is.

    Bytes that the wrong charset lost are lost. Text in another charset is hardly ever valid UTF-8.
    """
    if line.isascii() or not _MISREAD.search(line):
        return line
    lost = line.count("\ufffd")
    for charset in _CHARSETS:
        try:
            raw = line.replace("\ufffd", "").encode(charset)
        except UnicodeEncodeError:
            continue
        good = raw.decode("utf-8", "ignore")
        if not good.isascii() and len(raw) - len(good.encode()) <= 2 * lost:
            return good
    return line


def _split(line: str) -> list[str]:
    """The line cut at the space after each mark that ends a sentence, but not after ordinals such as "3."."""
    out, at = [], 0
    for m in _BREAK.finditer(line):
        mark = m.start()
        if mark and not line[mark - 1].isdecimal():
            out.append(line[at : mark + 1])
            at = m.end()
    out.append(line[at:])
    return out


def body_sentences(text: str | None) -> list[str]:
    """The sentences of a page's own body.

    Menus, titles, notices with their buttons and footers are lines that do not end as sentences do.
    A body that was cut off keeps the whole sentences of its last line, if it has body before that. A
    question belongs to the sentence that answers it. Null, empty and blank texts have none.
    """
    if not text:
        return []
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    out: list[str] = []
    for k, line in enumerate(lines):
        line = reread_line(line)
        if line.endswith(_ENDS):
            out += _split(line)
        elif k == len(lines) - 1 and out:
            out += _split(line)[:-1]
    return out


def term_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class _Pieces(dict):
    """The number of each piece of text without space, given as it is first met, and the term hashes of its words.

    Pieces repeat far more than texts, so that words are looked for and hashed once a piece. No space is in a word.
    """

    def __init__(self) -> None:
        super().__init__()
        self.ends, self.hashes, self.text = array("q", [0]), array("I"), 0

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.hashes.extend(map(term_hash, _WORD.findall(piece)))
        self.ends.append(len(self.hashes))
        self.text += len(piece)
        return number

    def terms(self, pieces: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The term hashes of pieces one after the other, and where those of the first ``ends`` pieces end."""
        held, number = np.array(self.ends), np.asarray(pieces, np.int64)
        size = np.diff(held)[number]
        after = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(after[-1]) + np.repeat(held[number] - after[:-1], size)
        return np.array(self.hashes, np.uint32)[at], after[np.asarray(ends, np.int64)].astype(np.int32)


#: Pieces, and characters of these, beyond which a task forgets them and begins anew.
PIECES, PIECES_TEXT = 500_000, 20_000_000

_HASHED = "ids binary, sentence_ends binary, doc_ends binary, terms binary"


def hashed_chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Chunks of documents: doc ids, term hashes, ends of sentences in these and of documents in sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Pieces()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                done: list[tuple[np.ndarray, np.ndarray]] = []
                pieces: list[int] = []
                ends, doc_ends = [], [0]
                for value in part.column(1).to_pylist():
                    if len(known) > PIECES or known.text > PIECES_TEXT:
                        done.append(known.terms(pieces, ends))
                        known, pieces, ends = _Pieces(), [], []
                    sentences = body_sentences(value)
                    for sentence in sentences:
                        pieces += map(known.__getitem__, sentence.lower().split())
                        ends.append(len(pieces))
                    doc_ends.append(doc_ends[-1] + len(sentences))
                done.append(known.terms(pieces, ends))
                before = np.cumsum([0] + [len(terms) for terms, _ in done])
                term_ends = np.concatenate([e + n for (_, e), n in zip(done, before)]).astype(np.int32)
                yield _row(
                    np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64), term_ends,
                    np.asarray(doc_ends[1:], np.int32), np.concatenate([terms for terms, _ in done]),
                    names=["ids", "sentence_ends", "doc_ends", "terms"],
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, _HASHED)


def _row(*arrays: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=names)


def _arrays(batch: pa.RecordBatch, kinds: dict[str, type]) -> Iterator[dict[str, np.ndarray]]:
    for i in range(batch.num_rows):
        yield {n: np.frombuffer(batch.column(n)[i].as_buffer(), k) for n, k in kinds.items()}


_IN = {"ids": np.int64, "sentence_ends": np.int32, "doc_ends": np.int32, "terms": np.uint32}


def _docs_of(c: dict[str, np.ndarray]) -> np.ndarray:
    """The document, as a number in its chunk, of every term."""
    ends = np.concatenate([[0], c["sentence_ends"]])[np.concatenate([[0], c["doc_ends"]])]
    return np.repeat(np.arange(len(c["doc_ends"])), np.diff(ends))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys of 0 and more in order, by sorting: ``np.unique`` without counts goes through a hash table, which takes far longer."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) > 0]


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """``term, df`` over all documents; chunks are counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _arrays(batch, _IN):
                both = _distinct((_docs_of(c).astype(np.int64) << 32) | c["terms"])
                term, n = np.unique(both & 0xFFFFFFFF, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])

    return chunks.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


_CODED = "ids binary, sentence_ends binary, doc_ends binary, terms binary, ptr binary, cols binary, weights binary"
_OUT = {
    "ids": np.int64, "sentence_ends": np.int32, "doc_ends": np.int32, "terms": np.int32,
    "ptr": np.int64, "cols": np.int32, "weights": np.float32,
}


def _code(c: dict[str, np.ndarray], vocabulary: np.ndarray, idf: np.ndarray) -> list[np.ndarray]:
    """The terms of the vocabulary as its numbers, others left out, and the documents' tf-idf vectors of length 1, row by row."""
    at = np.searchsorted(vocabulary, c["terms"])
    at[at == len(vocabulary)] = 0
    held = vocabulary[at] == c["terms"] if len(vocabulary) else np.zeros(len(at), bool)
    coded = at[held].astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(held)])[c["sentence_ends"]].astype(np.int32)
    key, n = np.unique((_docs_of(c)[held].astype(np.int64) << 32) | coded, return_counts=True)
    row, col = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
    weight = (np.log1p(n) * idf[col]).astype(np.float32)
    docs = len(c["doc_ends"])
    norm = np.sqrt(np.bincount(row, weight.astype(np.float64) ** 2, docs))
    weight = (weight / np.maximum(norm[row], 1e-9)).astype(np.float32)
    ptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=docs))]).astype(np.int64)
    return [c["ids"], ends, c["doc_ends"], coded, ptr, col, weight]


def coded_chunks(chunks: DataFrame, vocabulary: np.ndarray, idf: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _arrays(batch, _IN):
                yield _row(*_code(c, vocabulary, idf), names=list(_OUT))

    return chunks.mapInArrow(run, _CODED)


def _prepared(splits: list[dict[int, tuple[np.ndarray, int, int]]]) -> list[tuple[np.ndarray, ...]]:
    """Each level as the row of each node (-1 for nodes not split), the directions, and the halves of each row."""
    out = []
    for level in splits:
        nodes = sorted(level)
        if nodes:
            lookup = np.full(max(nodes) + 2, -1)
            lookup[nodes] = np.arange(len(nodes))
            halves = np.array([level[n][1:] for n in nodes])
            out.append((lookup, np.stack([level[n][0] for n in nodes]), halves))
    return out


_SENTENCES = {n: _OUT[n] for n in ("ids", "sentence_ends", "doc_ends", "terms")}


def _values(c: dict[str, np.ndarray], live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-zero values of some documents: number of the document among them, column, weight."""
    size = np.diff(c["ptr"])[live]
    rows = np.repeat(np.arange(len(live)), size)
    if len(live) == len(c["ptr"]) - 1:
        return rows, c["cols"], c["weights"]
    ends = np.cumsum(size)
    at = np.arange(len(rows)) + np.repeat(c["ptr"][live] - (ends - size), size)
    return rows, c["cols"][at], c["weights"][at]


def _sides(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, which: np.ndarray, table: np.ndarray) -> np.ndarray:
    """On which side of its node's direction (a row of ``table``) each document lies."""
    along = table.ravel()[(which * table.shape[1])[rows] + cols]
    return np.bincount(rows, weights * along, len(which)) > 0


def _descend(c: dict[str, np.ndarray], levels: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """The node of each document after the given levels; a document stays where its node was not split."""
    node = np.zeros(len(c["ptr"]) - 1, np.int64)
    live = np.arange(len(node))
    for lookup, table, halves in levels:
        which = lookup[np.minimum(node[live], len(lookup) - 1)]
        live, which = live[which >= 0], which[which >= 0]
        if not len(live):
            break
        side = _sides(*_values(c, live), which, table)
        node[live] = halves[which, side.astype(np.int64)]
    return node


def _add_up(df: DataFrame, add, groups: int, width: int) -> dict[int, tuple[int, np.ndarray]]:
    """Counts and vectors of groups, added up over all chunks: ``add(batches, count, total)`` adds a task's to its arrays.

    A task sends one sparse row a group. Where tasks are many, rows are added up by group before the driver takes them.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(groups, np.int64), np.zeros(groups * width)
        add(batches, count, total)
        yield packed((n, int(count[n]), total[n * width : (n + 1) * width]) for n in range(groups) if count[n])

    def packed(found):
        rows = [(n, d, np.flatnonzero(v), v) for n, d, v in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[3][r[2]].tobytes() for r in rows], pa.binary()),
            ], names=["node", "docs", "cols", "total"],
        )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for batch in batches:
            merge(acc, zip(*(c.to_pylist() for c in batch.columns)))
        yield packed((n, d, v) for n, (d, v) in acc.items())

    def merge(acc: dict[int, list], rows) -> None:
        for n, d, cols, total in rows:
            got = acc.setdefault(n, [0, np.zeros(width)])
            got[0] += d
            got[1][np.frombuffer(cols, np.int32)] += np.frombuffer(total, np.float64)

    ddl = "node bigint, docs bigint, cols binary, total binary"
    sent = _few_tasks(df).mapInArrow(part, ddl)
    if TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism > TASKS_TO_DRIVER:
        sent = sent.repartition("node").mapInArrow(join, ddl)
    out: dict[int, list] = {}
    merge(out, sent.collect())  # bounded by groups x vocabulary x tasks
    return {n: (d, v) for n, (d, v) in out.items()}


def _accumulate(total: np.ndarray, key: np.ndarray, weights: np.ndarray | None) -> None:
    if 4 * len(key) < len(total):
        np.add.at(total, key, 1 if weights is None else weights)
    else:
        total += np.bincount(key, weights, len(total))


_WORK = {"place": np.int32, "ids": np.int64, "ptr": np.int64, "cols": np.int32, "weights": np.float32}
_WORK_DDL = ", ".join(f"{n} binary" for n in _WORK)
_VECTORS = {n: k for n, k in _WORK.items() if n != "place"}


def _few_tasks(df: DataFrame) -> DataFrame:
    """A few tasks a core, whatever the data: each sends one sparse row a node, so what is shuffled is bounded."""
    return df.coalesce(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def _kept(c: dict[str, np.ndarray], place: np.ndarray) -> dict[str, np.ndarray]:
    """The documents with a place of 0 or more."""
    live = np.flatnonzero(place >= 0)
    _, cols, weights = _values(c, live)
    ptr = np.concatenate([[0], np.cumsum(np.diff(c["ptr"])[live])]).astype(np.int64)
    return {"place": place[live].astype(np.int32), "ids": c["ids"][live], "ptr": ptr, "cols": cols, "weights": weights}


def _followed(c: dict[str, np.ndarray], table: np.ndarray, goes: np.ndarray) -> np.ndarray:
    """The place that each document goes on to by its side of its node's direction."""
    side = _sides(*_values(c, np.arange(len(c["place"]))), c["place"].astype(np.int64), table)
    return goes[c["place"], side.astype(np.int64)]


def _add_sums(
    c: dict[str, np.ndarray], table: np.ndarray | None, moving: np.ndarray | None, width: int, count: np.ndarray, total: np.ndarray
) -> None:
    live = np.arange(len(c["place"])) if moving is None or moving[c["place"]].all() else np.flatnonzero(moving[c["place"]])
    rows, cols, weights = _values(c, live)
    node = c["place"][live].astype(np.int64)
    if table is not None:
        node = 2 * node + _sides(rows, cols, weights, node, table)
    count += np.bincount(node, minlength=len(count))
    _accumulate(total, (node * width)[rows] + cols, weights)


def _add_seeds(c: dict[str, np.ndarray], kept: dict[int, list]) -> dict[int, list]:
    mark = ((c["ids"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
    limit = np.full(int(c["place"].max(initial=0)) + 1, np.iinfo(np.int64).max)
    for p, held in kept.items():
        if len(held) == SEED_DOCS and p < len(limit):
            limit[p] = held[-1][0]
    who = np.flatnonzero(mark <= limit[c["place"]])
    who = who[np.lexsort((mark[who], c["place"][who]))]
    start = np.flatnonzero(np.diff(c["place"][who], prepend=-1))
    rank = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
    for i in who[rank < SEED_DOCS]:
        s = slice(c["ptr"][i], c["ptr"][i + 1])
        kept.setdefault(int(c["place"][i]), []).append((int(mark[i]), int(c["ids"][i]), c["cols"][s].tobytes(), c["weights"][s].tobytes()))
    return {p: sorted(held)[:SEED_DOCS] for p, held in kept.items()}


def _add_farthest(c: dict[str, np.ndarray], centres: dict[int, np.ndarray], held: dict[int, tuple]) -> None:
    for p, centre in centres.items():
        mine = np.flatnonzero(c["place"] == p)
        if len(mine):
            rows, cols, weights = _values(c, mine)
            like = np.bincount(rows, weights * centre[cols], len(mine))
            i = mine[(k := np.lexsort((c["ids"][mine], like))[0])]
            at = slice(c["ptr"][i], c["ptr"][i + 1])
            one = (float(like[k]), int(c["ids"][i]), c["cols"][at].tobytes(), c["weights"][at].tobytes())
            held[p] = min(held.get(p, one), one)


def _dense(cols: bytes, values: bytes, kind: type, width: int) -> np.ndarray:
    out = np.zeros(width)
    out[np.frombuffer(cols, np.int32)] = np.frombuffer(values, kind)
    return out


_SEED = pa.struct([("m", pa.int64()), ("i", pa.int64()), ("c", pa.binary()), ("w", pa.binary())])
_SEED_DDL = "place bigint, seeds array<struct<m:bigint,i:bigint,c:binary,w:binary>>"


class _Cluster:
    """The documents of a level's nodes as written chunks; every method is a pass over all of them."""

    def __init__(self, df: DataFrame, width: int, path: str | None = None):
        self.df, self.width, self.path, self.spark = df, width, path, df.sparkSession

    def sums(self, places: int, table: np.ndarray | None = None, moving: np.ndarray | None = None) -> dict[int, tuple[int, np.ndarray]]:
        """Documents and sum of vectors of each place or, by the directions of ``table``, of its halves (2p and 2p + 1).

        ``moving`` tells of each place whether it is asked for (None: all are).
        """
        shared, width = self.spark.sparkContext.broadcast(table), self.width  # bounded by nodes x vocabulary

        def add(batches: Iterator[pa.RecordBatch], count: np.ndarray, total: np.ndarray) -> None:
            for batch in batches:
                for c in _arrays(batch, _WORK):
                    _add_sums(c, shared.value, moving, width, count, total)

        out = _add_up(self.df, add, places if table is None else 2 * places, width)
        shared.unpersist()
        return out

    def seeds(self) -> dict[int, list]:
        """Of each place its documents of smallest hash, ``SEED_DOCS`` at most; a task sends no more than that."""

        def packed(kept: dict[int, list]) -> pa.RecordBatch:
            seeds = [[dict(zip("micw", x)) for x in held] for held in kept.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(seeds, pa.list_(_SEED))], names=["place", "seeds"])

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, list] = {}
            for batch in batches:
                for c in _arrays(batch, _WORK):
                    kept = _add_seeds(c, kept)
            yield packed(kept)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, list] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    kept[r["place"]] = sorted(kept.get(r["place"], []) + [(s["m"], s["i"], s["c"], s["w"]) for s in r["seeds"]])[:SEED_DOCS]
            yield packed(kept)

        rows = _few_tasks(self.df).mapInArrow(part, _SEED_DDL).repartition("place").mapInArrow(join, _SEED_DDL).collect()
        return {r["place"]: r["seeds"] for r in rows}

    def farthest(self, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Of each place of ``centres`` the vector of its document least like its centre, ties by id."""
        shared, width = self.spark.sparkContext.broadcast(centres), self.width
        far = pa.struct([("l", pa.float64()), ("i", pa.int64()), ("c", pa.binary()), ("w", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}
            for batch in batches:
                for c in _arrays(batch, _WORK):
                    _add_farthest(c, shared.value, held)
            rows = [{"place": p, "far": dict(zip("licw", x))} for p, x in held.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("place", pa.int64()), ("far", far)]))

        found = _few_tasks(self.df).mapInArrow(run, "place bigint, far struct<l:double,i:bigint,c:binary,w:binary>")
        rows = found.groupBy("place").agg(F.min("far").alias("far")).collect()
        shared.unpersist()
        return {r["place"]: _dense(r["far"]["c"], r["far"]["w"], np.float32, width) for r in rows}

    def _moved(self, table: np.ndarray, goes: np.ndarray) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((table, goes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in _arrays(batch, _WORK):
                    place = _followed(c, *shared.value)
                    if (place >= 0).any():
                        yield _row(*_kept(c, place).values(), names=list(_WORK))

        return _few_tasks(self.df).mapInArrow(run, _WORK_DDL)

    def divide(self, table: np.ndarray, goes: np.ndarray) -> "_Cluster":
        """The documents of the halves that go on, at the places that ``goes`` (place x side) names; -1 is left out."""
        path = write_shared(self._moved(table, goes), "work")
        self.drop()
        return _Cluster(reread(self.spark, path), self.width, path)

    def subtrees(self, table: np.ndarray | None, goes: np.ndarray | None, limit: float) -> dict[int, list]:
        """The whole subtrees of small nodes, each grown by one task that holds its documents."""
        df = self.df if table is None else self._moved(table, goes)
        width = self.width

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in _arrays(batch, _WORK):
                    for p in np.unique(c["place"]):
                        mine = _kept(c, np.where(c["place"] == p, 0, -1))
                        row = _row(*[mine[n] for n in _VECTORS], names=list(_VECTORS))
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *row.columns], names=["at", *_VECTORS])

        def grow(rows: pa.Table) -> pa.Table:
            held = [c for b in rows.select(list(_VECTORS)).to_batches() for c in _arrays(b, _VECTORS)]
            tree = pickle.dumps(_grow(_Memory(held, width), 1, limit)[0])
            return pa.table({"at": rows.column("at")[:1], "tree": pa.array([tree], pa.binary())})

        by_node = _few_tasks(df).mapInArrow(cut, "at bigint, " + ", ".join(f"{n} binary" for n in _VECTORS))
        return {r["at"]: pickle.loads(r["tree"]) for r in by_node.groupBy("at").applyInArrow(grow, "at bigint, tree binary").collect()}

    def drop(self) -> None:
        if self.path:
            drop_shared(self.spark, self.path)


class _Memory:
    """The documents of one small node, in memory: the same passes as ``_Cluster``."""

    def __init__(self, chunks: list[dict[str, np.ndarray]], width: int):
        ends = np.cumsum([0] + [c["ptr"][-1] for c in chunks])
        joined = {n: np.concatenate([c[n] for c in chunks]) for n in ("ids", "cols", "weights")}
        order = np.concatenate([c["ptr"][:-1] + e for c, e in zip(chunks, ends)] + [ends[-1:]]).astype(np.int64)
        self.c = {"place": np.zeros(len(joined["ids"]), np.int32), "ptr": order, **joined}
        self.width = width

    def sums(self, places: int, table: np.ndarray | None = None, moving: np.ndarray | None = None) -> dict[int, tuple[int, np.ndarray]]:
        nodes = places if table is None else 2 * places
        count, total = np.zeros(nodes, np.int64), np.zeros(nodes * self.width)
        _add_sums(self.c, table, moving, self.width, count, total)
        return {n: (int(count[n]), total[n * self.width : (n + 1) * self.width]) for n in range(nodes) if count[n]}

    def seeds(self) -> dict[int, list]:
        return {p: [dict(zip("micw", x)) for x in held] for p, held in _add_seeds(self.c, {}).items()}

    def farthest(self, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        held: dict[int, tuple] = {}
        _add_farthest(self.c, centres, held)
        return {p: _dense(x[2], x[3], np.float32, self.width) for p, x in held.items()}

    def divide(self, table: np.ndarray, goes: np.ndarray) -> "_Memory":
        self.c = _kept(self.c, _followed(self.c, table, goes))
        return self


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(np.linalg.norm(v), 1e-12)


def _start(seeds: list, width: int) -> np.ndarray | None:
    """The direction between two centres of a node's seed documents: the best 2-means of several starts.

    None where the seeds are (nearly) all alike.
    """
    if len(seeds) < 2:
        return None
    columns = [np.frombuffer(s["c"], np.int32) for s in seeds]
    used = np.unique(np.concatenate(columns))
    x = np.zeros((len(seeds), len(used)), np.float32)
    for k, s in enumerate(seeds):
        x[k, np.searchsorted(used, columns[k])] = np.frombuffer(s["w"], np.float32)
    like = x @ x.T
    best, way = -np.inf, None
    for a in range(0, len(seeds), max(1, len(seeds) // STARTS)):
        b = int(np.argmin(like[a]))
        if like[a, b] > 0.999:
            continue
        p, q = x[a], x[b]
        for _ in range(8):
            side = x @ (q - p) > 0
            if side.all() or not side.any():
                break
            p, q = _unit(x[~side].sum(0)), _unit(x[side].sum(0))
        else:
            small = min(side.sum(), len(side) - side.sum())
            gain = float((x[~side] @ p).sum() ** 2 / (~side).sum() + (x[side] @ q).sum() ** 2 / side.sum())
            gain -= len(x) * (small < OUTLIERS * len(x))  # a few odd documents are split off only if nothing else can be
            if gain > best:
                best, way = gain, np.zeros(width, np.float32)
                way[used] = q - p
    return way


def bisect_documents(chunks: DataFrame, width: int) -> list[dict[int, tuple[np.ndarray, int, int]]]:
    """Bisecting k-means over all documents: for each level, of each node split there, its direction and halves.

    Node 0 holds all documents. A level works on the documents of its nodes alone, written with the node of each;
    passes over all of these move the two centres of every node until no node's spread gets lower. A node of up to
    ``LOCAL_DOCS`` documents is finished in one task by the same steps, with the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _arrays(batch, _VECTORS):
                yield _row(*_kept(c, np.where(np.diff(c["ptr"]) > 0, 0, -1)).values(), names=list(_WORK))

    work = _few_tasks(chunks.select(*_VECTORS)).mapInArrow(run, _WORK_DDL)  # documents with any term, at place 0
    splits, used = _grow(_Cluster(work, width), 1, None)
    used.drop()
    return splits


def _grow(work, known: int, limit: float | None):
    """Grow a tree on the documents of ``work``, from node 0 on; its levels, and what is left of ``work``.

    ``known`` is the next node's number, ``limit`` the least spread of a node to be split (None: by this one's).
    """
    width, splits = work.width, []
    state = work.sums(1)
    if not state:
        return splits, work
    spread = _spreads(state)
    limit = LEAST_SPREAD * spread[0] if limit is None else limit
    nodes = [0]  # of each place the node

    def graft(trees: dict[int, list], roots: dict[int, int], depth: int, known: int) -> int:
        for at, tree in sorted(trees.items()):
            names = {0: roots[at]}
            for i, level in enumerate(tree):
                while len(splits) <= depth + i:
                    splits.append({})
                for n, (way, left, right) in sorted(level.items()):
                    names[left], names[right] = known, known + 1
                    splits[depth + i][names[n]] = (way, known, known + 1)
                    known += 2
        return known

    if isinstance(work, _Cluster) and state[0][0] <= LOCAL_DOCS:
        graft(work.subtrees(None, None, limit), {0: 0}, 0, known)
        return splits, work
    depth = 0
    while nodes:
        seeds, table, alike = work.seeds(), np.zeros((len(nodes), width), np.float32), {}
        moving = set()
        for p in range(len(nodes)):
            way = _start(seeds[p], width)
            if way is not None:
                table[p] = way
                moving.add(p)
            elif spread[p] > 1e-3 * state[p][0]:
                alike[p] = _unit(state[p][1])
        for p, far in (work.farthest(alike) if alike else {}).items():
            table[p] = far - alike[p]
            moving.add(p)
        split = sorted(moving)
        parts = work.sums(len(nodes), table)
        below = _spreads(parts)
        while moving:
            left = {p: _below(below, p) for p in moving}
            for p in sorted(moving):
                if 2 * p in parts and 2 * p + 1 in parts:
                    table[p] = _unit(parts[2 * p + 1][1]) - _unit(parts[2 * p][1])
                else:
                    moving.discard(p)
            if not moving:
                break
            # the halves of settled nodes, whose directions stay, stay as they are
            parts = {n: x for n, x in parts.items() if n // 2 not in moving} | work.sums(len(nodes), table, np.isin(np.arange(len(nodes)), list(moving)))
            below = _spreads(parts)
            moving = {p for p in moving if left[p] - _below(below, p) > SETTLED * spread[p]}
        while len(splits) <= depth:
            splits.append({})
        following, small = [], {}
        goes, goes_small = np.full((len(nodes), 2), -1), np.full((len(nodes), 2), -1)
        for p in split:
            splits[depth][nodes[p]] = (table[p].copy(), known, known + 1)
            docs = [parts[2 * p + s][0] if 2 * p + s in parts else 0 for s in (0, 1)]
            done = set()
            if 1 - _below(below, p) / spread[p] < LEAST_GAIN + CHANCE / state[p][0]:
                few = OUTLIERS * sum(docs)
                done = {s for s in (0, 1) if min(docs) > few or docs[s] <= few}
            for s in (0, 1):
                if s not in done and 1 < docs[s] < state[p][0] and below[2 * p + s] >= limit:
                    if isinstance(work, _Cluster) and docs[s] <= LOCAL_DOCS:
                        goes_small[p, s] = len(small)
                        small[len(small)] = known + s
                    else:
                        goes[p, s] = len(following)
                        following.append((known + s, parts[2 * p + s], below[2 * p + s]))
            known += 2
        depth += 1
        if small:
            known = graft(work.subtrees(table, goes_small, limit), small, depth, known)
        nodes = [n for n, _, _ in following]
        state = dict(enumerate(x for _, x, _ in following))
        spread = dict(enumerate(x for _, _, x in following))
        if nodes:
            work = work.divide(table, goes)
    return [level for level in splits if level], work


def _below(spread: dict[int, float], place: int) -> float:
    return spread.get(2 * place, 0.0) + spread.get(2 * place + 1, 0.0)


def _spreads(state: dict[int, tuple[int, np.ndarray]]) -> dict[int, float]:
    """Sum of squared distances of each node's documents to their centre."""
    return {n: docs - float(np.linalg.norm(total)) ** 2 / max(docs, 1) for n, (docs, total) in state.items()}


def _count_terms(chunks: DataFrame, assign, groups: int, width: int, kinds: dict[str, type]) -> np.ndarray:
    """Counts of terms by group over all sentences: groups x width. ``assign`` gives each sentence's group or -1 by the columns ``kinds``."""

    def add(batches: Iterator[pa.RecordBatch], count: np.ndarray, total: np.ndarray) -> None:
        for batch in batches:
            for c in _arrays(batch, kinds):
                of = assign(c)
                count += np.bincount(of[of >= 0], minlength=groups)
                owner = np.repeat(of, np.diff(np.concatenate([[0], c["sentence_ends"]])))
                use = owner >= 0
                _accumulate(total, owner[use] * width + c["terms"][use], None)

    out = np.zeros((groups, width))
    for g, (_, v) in _add_up(chunks.select(*kinds), add, groups, width).items():
        out[g] = v
    return out


def _sentence_docs(c: dict[str, np.ndarray]) -> np.ndarray:
    return np.repeat(np.arange(len(c["doc_ends"])), np.diff(np.concatenate([[0], c["doc_ends"]])))


def example_weights(counts: np.ndarray) -> np.ndarray:
    """How much each term speaks for each subject among the labelled examples: terms x subjects, 0 to 1.

    A term's share in a subject, less what chance would give, held down for terms seen few times.
    """
    rate = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    share = rate / np.maximum(rate.sum(0, keepdims=True), 1e-12)
    seen = counts.sum(0)
    return (np.clip(share - 0.25, 0, None) * (seen / (seen + 2.0))).T


def leaf_mixtures(leaf_counts: np.ndarray, spoken: np.ndarray, top: int = 40) -> np.ndarray:
    """The subjects that each leaf's discriminative terms speak for: leaves x subjects, rows add up to 1 or are 0.

    A subject is in a leaf's mixture if it has the most evidence or nearly as much; a leaf whose terms speak for
    none, or for more than ``SHARED`` alike, has none.
    """
    total = leaf_counts.sum(0)
    base = total / max(total.sum(), 1)
    out = np.zeros((len(leaf_counts), spoken.shape[1]))
    for k, row in enumerate(leaf_counts):
        rate = row / max(row.sum(), 1)
        gain = np.where(rate > 0, rate * np.log(np.maximum(rate, 1e-12) / np.maximum(base, 1e-12)), 0)
        best = np.argsort(-gain, kind="stable")[:top]
        weight = np.clip(gain[best], 0, None)
        if weight.sum() <= 1e-9:
            continue
        score = (weight[:, None] * spoken[best]).sum(0) / weight.sum()
        held = (score > 0.1) & (score > score.max() / 1.6)
        if 1 <= held.sum() <= SHARED:
            out[k] = score * held / score[held].sum()
    return out


def leaf_parts(leaf_counts: np.ndarray, mixtures: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each leaf cut into one part for each subject of its mixture: term counts of the parts, subject of each.

    A leaf of one subject is one part. In a leaf of several, a term goes to these as the examples tell, and by
    the mixture where they tell nothing.
    """
    leaf, subject = np.nonzero(mixtures)
    told = (seen + mixtures.shape[1] * 0.1) / (seen.sum(0) + mixtures.shape[1])
    claim = mixtures[leaf, subject][:, None] * told[subject]
    whole = np.zeros_like(leaf_counts)
    np.add.at(whole, leaf, claim)
    return leaf_counts[leaf] * claim / np.maximum(whole[leaf], 1e-12), subject


def rate_weights(counts: np.ndarray, subject: np.ndarray, subjects: int, limit: float = 4.0) -> np.ndarray:
    """How much a term speaks for each subject by the leaves: log-ratios, terms x subjects; 0 is no evidence.

    A term's rate in a subject is its highest in any part of a leaf with that subject, small ones held down, so
    that a language spread over the leaves of all subjects says nothing. It is compared with that of the first
    subject that may not share the term, after ``SHARED`` others.
    """
    size = counts.sum(1, keepdims=True)
    rate = counts / np.maximum(size + 0.001 * size.sum(), 1e-12)
    best = np.zeros((subjects, counts.shape[1]))
    np.maximum.at(best, subject, rate)
    ranked = np.sort(best, 0)[::-1]
    base = (ranked[SHARED] if subjects > SHARED else 0) + 1e-4
    held = (best >= ranked[0] / 5) & (counts.sum(0) >= 4)
    return np.where(held, np.clip(np.log(np.maximum(best, 1e-9) / base), 0, limit), 0).T


def leaf_evidence(weights: np.ndarray, counts: np.ndarray, subject: np.ndarray) -> np.ndarray:
    """How much a term speaks for each part of a leaf: terms x parts.

    It speaks as much as for the part's subject, in the parts that use it, by its rate beside the highest rate
    among that subject's.
    """
    size = counts.sum(1, keepdims=True)
    rate = counts / np.maximum(size + 0.001 * size.sum(), 1e-12)
    best = np.zeros((weights.shape[1], counts.shape[1]))
    np.maximum.at(best, subject, rate)
    used = (rate > 0) & (rate >= best[subject] / USED)
    spoken = np.where(weights > WEAK, weights, 0)  # less is no evidence
    return np.where(used, spoken.T[subject], 0).T.astype(np.float32)


def spoken_weights(spoken: np.ndarray, everything: np.ndarray) -> np.ndarray:
    """Term weights from the sentences that were clearly about each subject: terms x subjects.

    A term counts if at least half of its uses are in such sentences. It speaks strongly for a subject
    with three quarters of these, weakly for up to ``SHARED`` subjects that share nearly all of them;
    a term spread wider, as the words of any text are, says nothing.
    """
    about = spoken.sum(0)
    share = spoken / np.maximum(about, 1)
    known = (about >= 4) & (about >= 0.5 * everything)
    own = (share >= 0.75) & known
    some = (share >= 0.12) & known & ~own.any(0)
    shared = some & (some.sum(0) <= SHARED) & ((share * some).sum(0) > 0.85)
    return np.where(own, STRONG * share, np.where(shared, WEAK + 0.1, 0)).T.astype(np.float32)


def _sparse(evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The evidence that is not zero: where each term's begins and ends, the part of a leaf, the evidence. Most terms have none."""
    term, part = np.nonzero(evidence)
    return np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(evidence)))]), part, evidence[term, part]


def _leaf_of(c: dict[str, np.ndarray], evidence: tuple[np.ndarray, ...], subject: np.ndarray, subjects: int, strict: bool = False) -> np.ndarray:
    """The part of a leaf that each sentence belongs to, -1 for none: its terms' evidence, and its page's where they are unclear.

    ``evidence`` is as ``_sparse`` gives it; work and memory are those of the sentences' terms with evidence, whatever
    the number of parts. ``strict`` leaves out sentences in which a part with another subject has half as much evidence.
    """
    ptr, part, value = evidence
    sentences, parts, size = len(c["sentence_ends"]), len(subject), np.diff(ptr)
    out = np.full(sentences, -1)
    use = size[c["terms"]] > 0
    owner = np.repeat(np.arange(sentences), np.diff(np.concatenate([[0], c["sentence_ends"]])))[use]
    once = _distinct(owner * len(size) + c["terms"][use])  # a repeated term says no more
    if not len(once):
        return out
    owner, terms = once // len(size), once % len(size)
    new = np.diff(owner, prepend=-1) > 0
    said_in, row = owner[new], np.cumsum(new) - 1  # the sentences with evidence, and among these that of each term
    many = size[terms]
    at = np.arange(many.sum()) + np.repeat(ptr[terms] - (np.cumsum(many) - many), many)
    pair = np.repeat(row, many) * parts + part[at]
    order = np.argsort(pair, kind="stable")
    pair, new = pair[order], np.diff(pair[order], prepend=-1) > 0
    score = np.zeros(new.sum(), np.float32)
    np.add.at(score, np.cumsum(new) - 1, value[at][order])
    pair = pair[new]
    row, leaf = pair // parts, pair % parts
    by = np.zeros((len(said_in), subjects), np.float32)  # the best part of each subject
    np.maximum.at(by.ravel(), row * subjects + subject[leaf], score)
    doc, docs = _sentence_docs(c)[said_in], len(c["doc_ends"])
    i, kind = np.nonzero(by >= CLEAR)
    prior = np.bincount(doc[i] * subjects + kind, by[i, kind], docs * subjects).reshape(docs, subjects)
    prior = (prior / np.maximum(prior.sum(1, keepdims=True), 1e-9))[doc]
    every = np.arange(len(said_in))
    best = (by * (0.25 + prior)).argmax(1)
    said = by[every, best]
    if strict:
        rest = by.copy()
        rest[every, best] = 0
        known = (said >= CLEAR) & (rest.max(1) <= 0.5 * said)
    else:
        known = (said >= CLEAR) | ((said > WEAK) & (prior[every, best] >= PAGE))
    top = np.flatnonzero((subject[leaf] == best[row]) & (score == said[row]) & known[row])
    top = top[np.diff(row[top], prepend=-1) > 0]  # of equal parts the first
    out[said_in[row[top]]] = leaf[top]
    return out


def assign_subjects(
    docs: DataFrame, areas: DataFrame, examples: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, subject, share`` of each subject that at least a fifth of a page's sentences are about.

    Pages without body sentences, and those that no subject reaches, give no row. ``areas`` names the
    subjects and ``examples`` (subject, text; wrong labels are outvoted, null ones ignored) shows them;
    both are small by definition. Every document is read in every pass.
    """
    spark = docs.sparkSession
    names = sorted(r["subject"] for r in areas.select("subject").where("subject is not null").distinct().collect())
    chunks = materialize(hashed_chunks(docs, doc_id, text), "hashed")
    total = docs.count()
    df = document_frequencies(chunks)
    often = (F.col("df") >= max(2, LEAST_SHARE * total)) | F.col("term").isin(_example_terms(examples))
    kept = df.where(often & (F.col("df") <= max(2, MOST_SHARE * total)))
    terms = sorted(kept.collect(), key=lambda r: r["term"])
    vocabulary = np.array([r["term"] for r in terms], np.uint32)
    idf = np.log(max(total, 1) / np.array([r["df"] for r in terms], np.float64)) if terms else np.zeros(0)
    width = len(vocabulary)
    schema = "doc_id bigint, subject string, share double"
    if not width or not names:
        return spark.createDataFrame([], schema)
    coded = materialize(coded_chunks(chunks, vocabulary, idf), "coded")
    seen = _example_counts(examples, names, vocabulary)
    splits = bisect_documents(coded, width)
    leaves, levels, kinds = np.array(_leaves(splits)), _prepared(splits), len(names)

    def by_leaf(c):
        return np.searchsorted(leaves, _descend(c, levels))[_sentence_docs(c)]

    counts = _count_terms(coded, by_leaf, len(leaves), width, _OUT)
    everything = counts.sum(0)
    counts, subject = leaf_parts(counts, leaf_mixtures(counts, example_weights(seen)), seen)
    if not len(subject):
        return spark.createDataFrame([], schema)
    evidence = _sparse(leaf_evidence(rate_weights(counts, subject, kinds), counts, subject))
    for _ in range(REFINEMENTS):
        counts = _count_terms(coded, lambda c, e=evidence: _leaf_of(c, e, subject, kinds, True), len(subject), width, _SENTENCES)
        spoken = np.zeros((kinds, width))
        np.add.at(spoken, subject, counts)
        evidence = _sparse(leaf_evidence(spoken_weights(spoken, everything), counts, subject))
    of_part = np.eye(kinds)[subject]  # the subject of each part of a leaf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _arrays(batch, _SENTENCES):
                leaf = _leaf_of(c, evidence, subject, kinds)
                doc, docs = _sentence_docs(c), len(c["doc_ends"])
                held = leaf >= 0
                mixture = np.bincount(doc[held] * len(subject) + leaf[held], minlength=docs * len(subject)).reshape(docs, -1)
                share = mixture @ of_part / np.maximum(np.bincount(doc, minlength=docs), 1)[:, None]
                who, which = np.nonzero(share >= LEAST_MIX - 1e-9)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c["ids"][who]), pa.array([names[i] for i in which], pa.string()), pa.array(share[who, which])],
                    names=["doc_id", "subject", "share"],
                )

    return coded.select(*_SENTENCES).mapInArrow(run, schema)


def _example_terms(examples: DataFrame) -> list[int]:
    texts = [r["text"] or "" for r in examples.select("text").collect()]
    return sorted({term_hash(w) for text in texts for w in _WORD.findall(text.lower())})


def _example_counts(examples: DataFrame, names: list[str], vocabulary: np.ndarray) -> np.ndarray:
    """Counts of terms by subject among the labelled examples: subjects x terms.

    Where the examples tell their language, counts are scaled to the same amount of text for all subjects
    in it: of two subjects that claim a term, it belongs to the one whose few texts are full of it rather
    than to the one that wrong labels gave some. Examples are few by definition and read on the driver.
    """
    width = len(vocabulary)
    lang = F.col("lang") if "lang" in examples.columns else F.lit(None)
    shown = [r for r in examples.select("subject", "text", F.lower(lang.cast("string")).alias("lang")).collect() if r["subject"] in names]
    by: dict[str | None, np.ndarray] = {}
    for r in shown:
        counts = by.setdefault(r["lang"], np.zeros((len(names), width)))
        for sentence in body_sentences(r["text"]) or [r["text"] or ""]:
            hashes = np.array([term_hash(w) for w in _WORD.findall(sentence.lower())], np.uint32)
            at = np.minimum(np.searchsorted(vocabulary, hashes), width - 1)
            np.add.at(counts[names.index(r["subject"])], at[vocabulary[at] == hashes], 1)
    seen = np.zeros((len(names), width))
    for counts in by.values():
        size = counts.sum(1, keepdims=True)
        seen += counts * np.where(size > 0, size[size > 0].mean() / np.maximum(size, 1), 0) if size.any() else 0
    return seen


def _leaves(splits: list[dict]) -> list[int]:
    nodes, split = {0}, {n for level in splits for n in level}
    for level in splits:
        for _, left, right in level.values():
            nodes |= {left, right}
    return sorted(nodes - split)
