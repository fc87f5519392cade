"""Near-duplicate passages by compact windows over min-hashes of word 5-grams.

For each of HASHES hash functions the shingles of a document form a Cartesian tree by their hash: a node's shingle is the
minimum of every stretch that holds it within the node's span.  Nodes that span at least a passage of PASSAGE words are the
compact windows: all passages whose minimum is that shingle, in one row.  They are found as the runs of equal minima of a
sliding window of one passage, and their spans are kept as far as a passage of that length around the minimum reaches:
longer passages are made up of these.  Windows of one hash function join when their minima are the same shingle, and
their spans are then verified: a stretch of at least PASSAGE words around the minimum with Jaccard similarity of at least
SIMILARITY on its shingles.  One hash function that agrees is enough to verify: an exact repeat agrees in all of them, a
repeat at the threshold in at least one of four with a probability of 1 - 0.25 ** 4 or 0.996.

Windows whose minimum occurs in one document only never leave their batch.  Within a batch, windows of a key with equal
spans are one: the others are repeats of the first, whole, and stay behind, and whatever repeats one of them later repeats
the first as well.  All that remain of a key are compared with each other.  A key of more than BLOCK documents is dealt into
blocks, and each pair of blocks is a cell of its own, so cells of one key spread over tasks.  A window is compared with those
of smaller documents until its whole span is known to be repeated, and only with ones that share enough shingles for a match
and hold a shingle not yet covered: the others could add nothing.  Those that share most come first, then those that hold
most of what is not yet covered; shingles that no smaller document has in the cell count for nothing.  A link leads from a document to one with a smaller id.

Nulls: a null text is empty, documents shorter than a passage have none; rows without an id neither give nor take links,
and rows that share an id are never linked with each other.  Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import PRIME, give_back, grams, in_batches, mix, texts, word_hashes
from quaestor.llm.counting import distinct, to_keys, with_totals, words_in

SHINGLE, PASSAGE, SIMILARITY = 5, 50, 0.75
WIDTH = PASSAGE - SHINGLE + 1
#: Shingles that two stretches of WIDTH share at least where their similarity suffices; longer ones share more.
LEAST = math.ceil(2 * WIDTH * SIMILARITY / (1 + SIMILARITY))
HASHES = 4
BATCH_BYTES = 4 << 20
#: Documents of a key in a block, earlier windows screened at a time, and windows kept in the form for comparisons.
BLOCK, SCREEN, KEPT = 2048, 256, 256
#: Cells of so many windows are compared one by one; cells of more than INDEXED look their candidates up by rare shingles.
SMALL, INDEXED = 6, 256
#: How many rare shingles a candidate may have to hold, and what comparing one costs in entries of the index.
ENOUGH, LOOK = np.array([1, 2, 4, 8, 16, LEAST]), 64
SITES = "kind int, key long, cell int, doc long, at int, place int, sketch binary, other long, first int, last int, other_first int, similarity double"
LINKS = "doc long, first int, last int, other long, other_first int, similarity double"


def compact_windows(shingles: np.ndarray, row: np.ndarray, seed: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of one hash function: c is the leftmost minimum of every stretch of l..r (inclusive) that holds it.

    l and r are the node's span in the tree, at most width - 1 away from c.
    shingles of neighbouring rows follow each other; row tells them apart.
    """
    n = len(shingles) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    low = (mix(shingles ^ np.uint64(mix(np.array([seed], np.uint64))[0])) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(shingles), dtype=np.uint64)
    span = 1
    while span * 2 <= width:  # low[p]: minimum of span shingles from p on
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    least = np.minimum(low[:n], low[width - span : width - span + n])
    start = np.flatnonzero(row[:n] == row[width - 1 :])
    c = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(c):
        return (np.zeros(0, np.int64),) * 3
    first = np.concatenate([[True], c[1:] != c[:-1]])
    last = np.concatenate([first[1:], [True]])
    return start[first], c[first], start[last] + width - 1


class Windows:
    """Compact windows of a batch; rows are numbered within the batch, shingles (l, c, r, begin) as well."""

    def __init__(self, table: pa.Table):
        parts, blocks, base = [], [], 0
        for chunk_at, chunk in _chunks(table.column("text")):
            for first, hashes, counts, _, _ in word_hashes(chunk):
                word_row = np.repeat(np.arange(len(counts)) + first + chunk_at, counts)
                s = grams(hashes, SHINGLE)
                n = len(s)
                row = word_row[:n].copy()
                row[row != word_row[SHINGLE - 1 :]] = -1  # reaches into the next document
                begin = np.cumsum(counts) - counts
                for f in range(HASHES):
                    l, c, r = compact_windows(s, row, f + 1)
                    keep = (row[l] >= 0) & (row[l] == row[c]) & (row[r] == row[c])
                    l, c, r = l[keep], c[keep], r[keep]
                    key, doc = mix(s[c] * np.uint64(PRIME) + np.uint64(f)), row[c]
                    parts.append((key, doc, l + base, c + base, r + base, begin[doc - first - chunk_at] + base))
                blocks.append(s)
                base += n
        kinds = dict(zip(("key", "doc", "l", "c", "r", "begin"), (np.uint64,) + (np.int64,) * 5))
        columns = zip(*parts) if parts else ([np.zeros(0, k)] for k in kinds.values())
        self.key, self.doc, self.l, self.c, self.r, self.begin = (np.concatenate(list(c)) for c in columns)
        self.shingles = np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)


def _chunks(column: pa.ChunkedArray):
    at = 0
    for chunk in column.chunks:
        yield at, chunk
        at += len(chunk)


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a batch and in how many of its documents each occurs."""
    w = Windows(table)
    key = to_keys(w.key)
    order = np.lexsort((w.doc, key))
    key, doc = key[order], w.doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return distinct(key[new])


class _Span:
    """Shingles of a window in the forms that its comparisons need: in order, by their last place, and the repeated ones."""

    __slots__ = ("at", "values", "where", "repeated")

    def __init__(self, values: np.ndarray, at: int):
        self.at, self.values = at, values.tolist()
        self.where = where = dict(zip(self.values, range(len(self.values))))
        self.repeated = set()
        if len(where) < len(self.values):
            self.repeated = {v for k, v in enumerate(self.values) if where[v] != k}


def verify(x: np.ndarray, at_x: int, y: np.ndarray, at_y: int):
    """First and last shingle of matching passages of two spans whose shingles at_x and at_y agree, and their similarity.

    None where there is no stretch of WIDTH shingles with a Jaccard similarity of SIMILARITY.
    """
    return _verified(_Span(x, at_x), _Span(y, at_y))


def _verified(x: _Span, y: _Span):
    """verify() of spans that are kept for other comparisons."""
    one, two, at_x, at_y = x.values, y.values, x.at, y.at
    left, right = min(at_x, at_y), min(len(one) - at_x, len(two) - at_y)
    if left + right >= WIDTH and one[at_x - left : at_x + right] == two[at_y - left : at_y + right]:
        return at_x - left, at_x + right - 1, at_y - left, at_y + right - 1, 1.0
    where = y.where
    pairs = [(i, where[v]) for i, v in enumerate(one) if v in where]
    if len(pairs) < LEAST:  # an upper bound of what any two stretches share
        return None
    repeated = x.repeated | y.repeated
    if repeated:
        names = {name: j for j, name in enumerate(_names(two, at_y, repeated))}
        pairs = [(i, names[name]) for i, name in enumerate(_names(one, at_x, repeated)) if name in names]
    return _stretch(pairs, at_x, len(one), at_y, len(two))


def _names(values: list[int], at: int, repeated: set[int]) -> list[int | None]:
    """Names that tell the places of a repeated shingle apart: by side of the minimum and distance from it in occurrences."""
    if not repeated:
        return values
    names = list(values)
    for side, places in ((0, range(at - 1, -1, -1)), (1, range(at + 1, len(values)))):
        seen: dict[int, int] = {}
        for k in places:
            v = values[k]
            if v in repeated:
                seen[v] = n = seen.get(v, 0) + 1
                names[k] = v + (2 * n + side << 16)  # shingles have 16 bits
    names[at] = None
    return names


def _stretch(pairs: list[tuple], at_x: int, size_x: int, at_y: int, size_y: int):
    """The stretches around the minimum that share most shingles at a Jaccard similarity of at least SIMILARITY.

    Where neighbours of matching ends match as well, longer stretches are more similar, so ends are those of runs of matches.
    Stretches shorter than WIDTH are filled up with shingles that count as different.
    """
    runs = _runs(pairs)
    found = _best_of_many(pairs, at_x, at_y) if runs is None else _best(runs, at_x)
    if found is None:
        return None
    a, b, c, d, similarity = found
    return (*_filled(a, b, size_x), *_filled(c, d, size_y), similarity)


def _runs(pairs: list[tuple]) -> list[tuple] | None:
    """Runs of neighbouring matches as (first, last, place of the first in the other span); None where matches cross."""
    runs, first, first_y, i, j = [], *pairs[0], *pairs[0]
    for k, m in pairs[1:]:
        if m <= j:
            return None
        if k != i + 1 or m != j + 1:
            runs.append((first, i, first_y))
            first, first_y = k, m
        i, j = k, m
    return [*runs, (first, i, first_y)]


def _best(runs: list[tuple], at_x: int):
    """The best stretches where matches do not cross: those from the start of a run to the end of a run."""
    middle = next(n for n, (_, last, _) in enumerate(runs) if last >= at_x)
    top, best = 0.0, None
    common_from = 0
    for a, last, c in runs[:middle]:
        common_from += last - a + 1
    for a, last_a, c in runs[: middle + 1]:
        common = common_from
        for first, b, other in runs[middle:]:
            common += b - first + 1
            d = other + b - first
            union = max(b - a + 1, WIDTH) + max(d - c + 1, WIDTH) - common
            if common >= SIMILARITY * union and common + common / union / 2 > top:
                top, best = common + common / union / 2, (a, b, c, d, common / union)
        common_from -= last_a - a + 1
    return best


def _best_of_many(pairs: list[tuple], at_x: int, at_y: int):
    """The best stretches where matches cross: any two ends of runs in one span with any two in the other."""
    both = set(pairs)
    starts = [(i, j) for i, j in pairs if (i - 1, j - 1) not in both]
    ends = [(i, j) for i, j in pairs if (i + 1, j + 1) not in both]
    i, j = np.array(pairs).T
    spans = []
    for k, at, places in ((0, at_x, i), (1, at_y, j)):
        low = np.array(sorted({v[k] for v in starts if v[k] <= at}))
        high = np.array(sorted({v[k] for v in ends if v[k] >= at}))
        low, high = np.repeat(low, len(high)), np.tile(high, len(low))
        spans.append((low, high, ((places >= low[:, None]) & (places <= high[:, None])).astype(np.float32)))
    (a, b, inside_x), (c, d, inside_y) = spans
    common = inside_x @ inside_y.T
    union = np.maximum(b - a + 1, WIDTH)[:, None] + np.maximum(d - c + 1, WIDTH) - common
    ratio = common / union
    good = common >= SIMILARITY * union
    if not good.any():
        return None
    n, m = np.unravel_index(int(np.where(good, common + ratio / 2, -1).argmax()), good.shape)
    return int(a[n]), int(b[n]), int(c[m]), int(d[m]), float(ratio[n, m])


def _filled(first: int, last: int, size: int) -> tuple[int, int]:
    """A stretch made as long as WIDTH within its span: to the right, then to the left."""
    last = max(last, min(first + WIDTH, size) - 1)
    return min(first, max(0, last - WIDTH + 1)), last


def _link(x: tuple[int, int], y: tuple[int, int], found: tuple) -> tuple:
    """Link of two spans (document, first shingle of the span), from the larger to the smaller document."""
    a, b, c, d, similarity = found
    one, two = (x[0], x[1] + a, x[1] + b), (y[0], y[1] + c, y[1] + d)
    (doc, first, last), (other, other_first, _) = (one, two) if one > two else (two, one)
    return doc, first, last, other, other_first, similarity


def _sites(table: pa.Table, totals: np.ndarray, block: int) -> pa.Table:
    """Windows whose key others have too, and links found within the batch (kind 1).

    Kind 0 is a window in a cell of one block, kinds 2 and 3 tell the two blocks of a cell apart.
    """
    w = Windows(table)
    ids = table.column("id").to_pylist()
    _, code = np.unique(to_keys(w.key), return_inverse=True)
    shared = np.flatnonzero(totals[code] > 1) if len(code) else np.zeros(0, np.int64)
    names = np.array([-1 if i is None else 1 for i in ids], np.int64)
    shared = shared[names[w.doc[shared]] > 0]
    doc_id = np.array([i if i is not None else 0 for i in ids], np.int64)
    shared = shared[np.lexsort((w.c[shared], doc_id[w.doc[shared]], w.key[shared]))]
    start = np.maximum(w.l, w.c - WIDTH + 1)
    end = np.minimum(w.r, w.c + WIDTH - 1)
    short = (w.shingles & np.uint64(0xFFFF)).astype(np.uint16)
    doc, place, size = doc_id[w.doc[shared]], w.c[shared] - start[shared], end[shared] - start[shared] + 1
    at = start[shared] - w.begin[shared]  # first shingle of the sketch within the document
    sketch = _slices(short, start[shared], size)
    rep = _firsts(code[shared], place, sketch)
    again = doc != doc[rep]
    links = _whole(doc, at, size, np.flatnonzero(again), rep)
    # links travel with the sites, spread by where they are
    spread = mix((links[0] * 31 + links[1]).view(np.uint64)).view(np.int64)
    kept = np.flatnonzero(~again)
    n = -(-totals[code[shared[kept]]] // block)
    row = np.repeat(kept, n)
    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    n = np.repeat(n, n)
    own = (mix(doc[row].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
    kind = np.where(own == other, 0, np.where(own < other, 2, 3))
    cell = np.minimum(own, other) * n + np.maximum(own, other)
    sites = [kind, w.key[shared[row]].view(np.int64), cell, doc[row], at[row], place[row], sketch.take(pa.array(row))]
    columns = [np.ones(len(spread), np.int64), spread, None, links[0], None, None, None, links[3], links[1], links[2], links[4], links[5]]
    pieces = [_record(sites + [None] * 5, len(row)), _record(columns, len(spread))]
    return pa.Table.from_batches(pieces).combine_chunks()


def _record(columns: list, n: int) -> pa.RecordBatch:
    """Columns of SITES; those that are None hold nulls."""
    arrays = [pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(columns, _TYPES)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _slices(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of 16-bit values as binary strings."""
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = values[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    large = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends * 2), pa.py_buffer(flat)])
    return large.cast(pa.binary())


def _firsts(group: np.ndarray, place: np.ndarray, sketch: pa.Array) -> np.ndarray:
    """For each window the first of its group with the same sketch around the minimum."""
    if not len(group):
        return np.zeros(0, np.int64)
    code = sketch.dictionary_encode().indices.to_numpy().astype(np.int64)
    _, index, inverse = np.unique((group * (2 * WIDTH) + place) * (code.max() + 1) + code, return_index=True, return_inverse=True)
    return index[inverse]


def _whole(doc: np.ndarray, at: np.ndarray, size: np.ndarray, rows: np.ndarray, rep: np.ndarray) -> list[np.ndarray]:
    """Columns of LINKS: windows that repeat the first of their class, in a smaller document, whole."""
    o = rep[rows]
    return [doc[rows], at[rows], at[rows] + size[rows] - 1, doc[o], at[o], np.ones(len(rows))]


_NAMES = [c.split(" ")[0] for c in SITES.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
_TYPES = [_KINDS[c.split(" ")[1]] for c in SITES.split(", ")]


def _match(batches):
    """Compare the windows of each cell of a key, which follow each other; pass links on."""
    names = [c.split(" ")[0] for c in LINKS.split(", ")]
    types = [_KINDS[c.split(" ")[1]] for c in LINKS.split(", ")]
    held = None
    for batch in itertools.chain(batches, [None]):
        table = held
        if batch is not None:
            kind = batch.column("kind").to_numpy()
            done = batch.filter(pa.array(kind == 1)).select(names)
            if done.num_rows:
                yield done
            new = pa.Table.from_batches([batch.filter(pa.array(kind != 1)).select(_NAMES[:7])])
            table = new if held is None else pa.concat_tables([held, new])
            key, cell = table.column("key").to_numpy(), table.column("cell").to_numpy()
            before = np.flatnonzero((key != key[-1:]) | (cell != cell[-1:])) if len(key) else key
            complete = int(before[-1]) + 1 if len(before) else 0
            held, table = table.slice(complete), table.slice(0, complete)  # the last cell may go on in the next batch
        if table is not None and table.num_rows:
            for columns in _cells(table.combine_chunks()):
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types)], names)
    give_back()


def _cells(table: pa.Table):
    """Columns of the links of whole cells: first of windows that equal the first of their class, then of all others.

    Windows of a cell with equal sketches are one class.  A member in a larger document than the first repeats it whole, so it
    is linked and left out: whatever it shares with others the first shares as well.  Members in the document of the first get
    its links.  In a cell of two blocks, members of one block are left out as the block's own cell links them.
    """
    kind, key, cell, doc, at, place = (table.column(c).to_numpy() for c in _NAMES[:6])
    sketch = table.column("sketch").chunk(0)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
    number = np.cumsum(new) - 1
    rep = _firsts(number, place.astype(np.int64), sketch)
    size = np.diff(np.frombuffer(sketch.buffers()[1], np.int32, len(sketch) + 1, sketch.offset * 4)) // 2
    yield _whole(doc, at, size, np.flatnonzero((doc != doc[rep]) & ((kind == 0) | (kind != kind[rep]))), rep)
    line = np.arange(len(rep))
    first = line[rep == line]
    several = (np.bincount(number[first]) > 1) & (doc[new] != doc[np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)])
    twins: dict[int, list[int]] = {}
    for k in np.flatnonzero((rep != line) & (doc == doc[rep]) & several[number]).tolist():
        twins.setdefault(int(rep[k]), []).append(int(at[k]))
    first = first[several[number[first]]]
    spans = sketch.take(pa.array(first)).to_pylist()
    group, rows, links = None, [], []
    for k, g, d, a, p, n, raw in zip(*(c.tolist() for c in (first, number[first], doc[first], at[first], place[first], kind[first])), spans):
        if g != group:
            _compare(rows, links)
            group, rows = g, []
        rows.append((d, a, p, np.frombuffer(raw, np.uint16), n, [a, *twins.get(k, ())]))
    _compare(rows, links)
    if links:
        yield list(zip(*links))


def _compare(rows: list, links: list[tuple]) -> None:
    """Links of windows of a cell, in order of documents, to those of smaller documents.

    A window is (doc, at, place, span, kind, all its places in the document).  In a cell of two blocks, to those of the other.
    """
    if len(rows) < 2:
        return
    cell = _Cell(rows) if len(rows) > SMALL else None
    spans: dict[int, _Span] = {}

    def verified(k: int, o: int):
        if len(spans) > KEPT:
            spans.clear()
        for n in (k, o):
            if n not in spans:
                spans[n] = _Span(rows[n][3], rows[n][2])
        return _verified(spans[k], spans[o])

    first = 0  # rows before it have smaller documents
    for k, (doc, at, _, span, kind, ats) in enumerate(rows):
        if rows[first][0] != doc and rows[k - 1][0] != doc:
            first = k
        if not first:
            continue
        # to be tried next: the last
        tried = cell.near(k, first) if cell else [o for o in range(first - 1, -1, -1) if not kind or rows[o][4] != kind]
        low, high, bounds, n_tried = None, None, None, 0
        while len(tried):
            o, tried, n_tried = int(tried[-1]), tried[:-1], n_tried + 1
            bounds = bounds if bounds is None else bounds[:, :-1]
            found = verified(k, o)
            news = False
            if found:
                links.extend(_link((doc, at), rows[o][:2], found) for at in ats)
                news = low is None or found[0] < low or found[1] > high
                low, high = (found[0], found[1]) if low is None else (min(low, found[0]), max(high, found[1]))
                if low == 0 and high == len(span) - 1:
                    break
            if bounds is None and cell and n_tried > 1 and len(tried) > SMALL:  # fewer are verified sooner than bounded
                tried, bounds = cell.bounds(k, tried)
                news = low is not None
            if news and len(tried):
                if bounds is not None:
                    more = (bounds[0] < low) | (bounds[1] > high)
                    tried, bounds = tried[more], bounds[:, more]
                elif cell:
                    tried = cell.holding(np.concatenate([span[:low], span[high + 1 :]]), tried)
                else:
                    rest = {*span[:low].tolist(), *span[high + 1 :].tolist()}
                    tried = [n for n in tried if not rest.isdisjoint(rows[n][3].tolist())]


class _Cell:
    """Windows of a cell side by side, to tell at once which of them can match another, or add to what is known of it.

    A window is a row of the table, its minimum in the middle; places beyond a window hold the minimum, too.  What of a window
    no earlier row has cannot match, and by the bounds of verify() most windows without a match are told by that alone.
    """

    def __init__(self, rows: list):
        self.rows, n = rows, len(rows)
        self.least = int(rows[0][3][rows[0][2]])
        self.table = np.full((n, 2 * WIDTH - 1), self.least, np.uint16)
        for line, (_, _, place, span, _, _) in zip(self.table, rows):
            line[WIDTH - 1 - place : WIDTH - 1 - place + len(span)] = span
        self.kinds = np.array([r[4] for r in rows])
        self.mark = np.zeros(1 << 16, np.uint8)
        self.where = np.full(1 << 16, -1, np.int16)
        docs = np.array([r[0] for r in rows])
        first = np.searchsorted(docs, docs)
        start = WIDTH - 1 - np.array([r[2] for r in rows])
        end = start + np.array([len(r[3]) for r in rows])
        self.known = np.zeros(self.table.shape, bool)
        self.enough = np.zeros(n, bool)
        self.minima = np.zeros(n, np.int64)
        places = np.arange(2 * WIDTH - 1)
        for kind in set(self.kinds.tolist()):
            others = np.flatnonzero(self.kinds != kind)[::-1] if kind else np.arange(n)[::-1]
            earliest = np.full(1 << 16, n, np.int32)
            for part in _parts(others):
                earliest[self.table[part]] = part[:, None]  # the last one stays
            for part in _parts(np.flatnonzero(self.kinds == kind)):
                table = self.table[part]
                inside = (places >= start[part, None]) & (places < end[part, None])
                self.minima[part] = ((table == self.least) & inside).sum(1)
                known = (earliest.take(table) < first[part, None]) & inside
                some = np.flatnonzero(known.sum(1) >= LEAST)
                part, known = part[some], known[some]
                low, high, held = _bounds(known, WIDTH - 1)
                self.known[part] = known & (places >= low[:, None]) & (places <= high[:, None])
                self.enough[part] = held >= LEAST
        self.index = _Rare([r[3] for r in rows]) if n > INDEXED and self.enough.any() else None

    def held(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which places of some rows hold one of the values."""
        self.mark[values] = 1
        found = self.mark.take(self.table.take(rows, 0))
        self.mark[values] = 0
        return found

    def near(self, k: int, first: int) -> np.ndarray:
        """Rows before first that share enough shingles with row k, those that share most last: they cover most of it."""
        if not self.enough[k]:
            return np.zeros(0, np.int64)
        values, kind = self.table[k][self.known[k]], self.kinds[k]
        possible = self.index.sharing(values, first) if self.index else np.arange(first)
        if kind:
            possible = possible[self.kinds[possible] != kind]
        values = values[values != self.least]
        shared = [self.minima[part] + self.held(values, part).sum(1, dtype=np.uint8) for part in _parts(possible)]
        shared = np.concatenate(shared) if shared else possible
        near = np.flatnonzero(shared >= LEAST)
        return possible[near[np.argsort(shared[near], kind="stable")]]

    def holding(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Those of some rows that hold one of the values, those that hold most last."""
        n = np.concatenate([self.held(values, part).sum(1, dtype=np.uint8) for part in _parts(rows)])
        order = np.argsort(n, kind="stable")
        return rows[order[np.count_nonzero(n == 0) :]]

    def bounds(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of some rows that can match row k, and bounds of what can match in row k: first and last shingles."""
        _, _, place, span, _, _ = self.rows[k]
        kept, bounds = [], []
        for part in _parts(rows):
            part = part[_bounds(self.held(span, part).view(bool), WIDTH - 1)[2] >= LEAST]
            low, high, held = _reach(span, place, self.table[part], self.where)
            good = held >= LEAST
            kept.append(part[good])
            bounds.append(np.stack([low[good], high[good]]))
        return np.concatenate(kept), np.concatenate(bounds, 1)


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[at : at + SCREEN] for at in range(0, len(rows), SCREEN)]


class _Rare:
    """Which windows of a cell hold a shingle, to look up all that can share LEAST shingles with a span by its rarest ones."""

    def __init__(self, spans: list[np.ndarray]):
        pairs = np.concatenate(spans).astype(np.int64) << 32 | np.repeat(np.arange(len(spans)), [len(s) for s in spans])
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        self.rows = pairs & 0xFFFFFFFF
        self.begin = np.searchsorted(pairs >> 32, np.arange((1 << 16) + 1))
        self.n = np.diff(self.begin)

    def sharing(self, values: np.ndarray, first: int) -> np.ndarray:
        """Rows before first that hold enough of the rarest of the shingles that a span can share.

        At most len(values) - LEAST of its places may be unshared, so of n places more at least n are shared.  The more are
        asked for, the fewer rows hold them and the more rows are looked at; n is the cheapest of ENOUGH, 0 if all rows are.
        """
        order = np.argsort(self.n[values], kind="stable")
        looked_at = np.cumsum(self.n[values[order]])[len(values) - LEAST + ENOUGH - 1]
        cost = looked_at * (1 + LOOK / ENOUGH)
        best = int(cost.argmin())
        if cost[best] > LOOK * first:
            return np.arange(first)
        n = int(ENOUGH[best])
        found = np.concatenate([self.rows[self.begin[v] : self.begin[v + 1]] for v in values[order[: len(values) - LEAST + n]].tolist()])
        if n == 1:
            found = np.unique(found)
            return found[: np.searchsorted(found, first)]
        return np.flatnonzero(np.bincount(found, minlength=first)[:first] >= n)


def _bounds(held: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of what verify() can find in spans, one a row: first and last shingle, and how many between them are held.

    A stretch of n shingles has at most as many shingles in common as it holds of the other span, and the other stretch is at
    least WIDTH long, so it needs held >= (3 n + 3 WIDTH) / 7 for a similarity of 3/4.  With +4 for a shingle that is held and
    -3 for one that is not, no similar stretch has a sum below 3 WIDTH.  What a stretch is filled up with counts as -3.
    """
    score = np.where(held, np.int16(4), np.int16(-3))
    ahead = np.cumsum(score[:, place + 1 :], axis=1, dtype=np.int16)
    behind = np.cumsum(score[:, :place][:, ::-1], axis=1, dtype=np.int16)
    none = np.zeros((len(held), 1), np.int16)
    ahead, behind = np.hstack([none, ahead]), np.hstack([none, behind])
    high = (ahead + (behind.max(1) + np.int16(4 - 3 * WIDTH))[:, None] >= 0) & held[:, place:]
    low = (behind + (ahead.max(1) + np.int16(4 - 3 * WIDTH))[:, None] >= 0) & held[:, place::-1]
    some = high.any(1) & low.any(1)
    last = np.where(some, place + ahead.shape[1] - 1 - high[:, ::-1].argmax(1), place - 1)
    first = np.where(some, place - (behind.shape[1] - 1 - low[:, ::-1].argmax(1)), place)
    up_to = np.hstack([none, np.cumsum(held, axis=1, dtype=np.int16)])
    line = np.arange(len(held))
    return first, last, up_to[line, last + 1] - up_to[line, first]


def _reach(span: np.ndarray, place: int, others: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of what verify() can find of a span in each of other windows: first and last shingle, and how many are held."""
    values, inverse = np.unique(span, return_inverse=True)
    where[values] = np.arange(len(values))
    held = np.zeros((len(others), len(values) + 1), bool)
    held[np.arange(len(others))[:, None], where[others]] = True  # -1, for shingles the span lacks, is the last column
    where[values] = -1
    return _bounds(held[:, :-1][:, inverse], place)


def links(docs: DataFrame) -> DataFrame:
    """doc, first, last (shingles, inclusive), other, other_first, similarity: verified repeats of earlier documents."""
    rows = texts(docs)
    sites = with_totals(in_batches(rows, BATCH_BYTES), _keys, partial(_sites, block=BLOCK), SITES, HASHES * 2 * words_in(rows) // WIDTH)
    ordered = sites.repartition("key", "cell").sortWithinPartitions("key", "cell", "doc", "at")
    return ordered.mapInArrow(_match, LINKS)


def _passages(table: pa.Table) -> pa.Table:
    """Overlapping or touching stretches of a document as one; the link that reaches the smallest document names it."""
    first, last, other, other_first = (table.column(c).to_numpy() for c in ("first", "last", "other", "other_first"))
    order = np.argsort(first, kind="stable")
    first, last, other, other_first = first[order], last[order], other[order], other_first[order]
    reach = np.maximum.accumulate(last)
    start = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1] + 1]))
    end = np.append(start[1:], len(first))
    low = [a + int(np.argmin(other[a:b])) for a, b in zip(start, end)]
    return pa.table(
        {
            "doc_id": table.column("doc").slice(0, 1).take([0] * len(start)),
            "first_word": pa.array(first[start], pa.int64()),
            "n_words": pa.array(reach[end - 1] - first[start] + SHINGLE, pa.int64()),
            "other_doc_id": pa.array(other[low], pa.int64()),
            "other_first_word": pa.array(other_first[low], pa.int64()),
            "similarity": pa.array(np.minimum.reduceat(table.column("similarity").to_numpy()[order], start), pa.float64()),
        }
    )


def passages(docs: DataFrame) -> DataFrame:
    """One row per repeated passage of a document: where it is, and an earlier document (smaller id) that has it."""
    schema = "doc_id long, first_word long, n_words long, other_doc_id long, other_first_word long, similarity double"
    return links(docs).groupBy("doc").applyInArrow(_passages, schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans (first word, number of words)."""
    column = pa.array([text])
    _, _, _, starts, ends = next(word_hashes(column))
    raw, out, at = text.encode(), [], 0
    for first, n in sorted(spans):
        begin, end = int(starts[first]), int(ends[min(first + n, len(ends)) - 1])
        if begin > at:
            out.append(raw[at:begin])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode()


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the passages that an earlier document has; one of which nothing is left goes."""
    found = passages(docs).groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "n_words")).alias("__spans"))
    columns = docs.columns

    @F.pandas_udf("string")
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(
            [t if s is None else cut(t, [(p["first_word"], p["n_words"]) for p in s]) for t, s in zip(text, spans)], dtype=object
        )

    joined = docs.withColumn("__id", F.col("doc_id").cast("long")).join(
        found.withColumnRenamed("doc_id", "__id"), "__id", "left"
    )
    had = F.col("__spans").isNotNull()
    left = joined.withColumn("text", F.when(had, rest("text", "__spans")).otherwise(F.col("text")))
    return left.where(~had | (F.length(F.trim(F.translate("text", "\t\n\x0b\f\r", "     "))) > 0)).select(*columns)
