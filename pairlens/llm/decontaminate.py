"""Benchmark decontamination by template windows.

Texts become sequences of canonical tokens: lower-cased words without the signs around them,
in which numbers, units after a number and names (words with a capital inside a sentence) are
typed placeholders that remember what they stand for.  A capitalised word that begins a sentence
may be a name or not, so windows over it are looked up in both forms.  All windows of ``WINDOW`` tokens of a
document are looked up in a hash table of the benchmark items' windows.  Where windows of an
item are found, slots are checked in each occurrence (windows of about the same distance between
document and item) and over the whole document: each value of the item must stand for the same value of the
document in all windows that count.  A document holds an item if windows that pass make up
``SHARE`` of the item's, or if they follow each other over ``RUN`` tokens.  So a question with
other numbers or names is found, and a text that only shares phrases with it is not.

Items of so few windows that one lost window is too many (none, for items of under ``WINDOW``
tokens and rows of numbers) are also looked up whole, by a hash of all their tokens: as they
are, and, from ``WINDOW`` tokens on, with placeholders whose values agree.

An item is looked at closer only where one of its key windows is found.  Keys are the rarest of its
windows, so many that no share of ``SHARE`` and no run of ``RUN`` tokens can do without one.  So a
window that thousands of items have in common leads to none of them by itself, and nothing is lost.

The table of the benchmark is broadcast, up to ``INDEX_CHARS`` characters of items; a larger
benchmark is dealt into parts by a hash of the item, which are built one after the other, and the
documents are scanned once for each part.  Scanning is narrow: documents are never shuffled, so
neither common passages nor hot sources weigh on one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

WINDOW = 5
SHARE = 0.8
RUN = 13
#: Tokens by which an occurrence may be longer or shorter than the item, up to any of its windows.
SLACK = 8
#: Items of fewer windows fall under ``SHARE`` if one is lost.
FEW = 5
INDEX_CHARS = 50_000_000
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡·•€£"
#: Words for numbers, and units that are slots after a number.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v a ma j kj n pa kpa c f k percent dollar dollars cent cents euro euros mph kmh kph kb mb gb tb meter meters metre metres"
).split()
NUM, UNIT, NAME = 1, 2, 3
FIRST_WORD = 4
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Tokens:
    """Canonical tokens of a column of texts: their codes, texts and values."""

    codes: np.ndarray  # 0: not in the vocabulary
    plain: np.ndarray  # the same without placeholders
    doc: np.ndarray
    either: np.ndarray  # capitalised words that begin a sentence: their code is the word's, but they may be names
    values: np.ndarray  # number of the lower-cased word in `words`
    words: object  # Arrow strings


def _distinct(texts):
    import pyarrow.compute as pc

    chunks = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    doc = np.repeat(np.arange(len(texts)), np.diff(chunks.offsets.to_numpy()))
    coded = chunks.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), doc


def tokenise(texts, vocabulary) -> Tokens:
    """Canonical tokens; ``vocabulary`` (Arrow strings) gives words their codes, None numbers all words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # a line break ends a sentence, as a full stop by itself does
    whole, which, doc = _distinct(pc.replace_substring_regex(texts, r"[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]+", " . "))
    core = pc.utf8_trim(whole, characters=SIGNS)
    words = pc.utf8_lower(core)

    def flags(x):
        return x.to_numpy(zero_copy_only=False).astype(bool)

    number = flags(pc.match_substring_regex(words, r"^[+-]?\d[\d.,:/]*[a-zµ°%]{0,4}$")) | flags(pc.is_in(words, pa.array(NUMBER_WORDS)))
    unit = flags(pc.is_in(words, pa.array(UNITS)))
    title = flags(pc.utf8_is_title(core)) & flags(pc.greater(pc.utf8_length(core), 1))
    stop = flags(pc.match_substring_regex(whole, r"[.!?:;]\W*$"))
    empty = flags(pc.equal(words, ""))
    codes = words.dictionary_encode().indices if vocabulary is None else pc.fill_null(pc.index_in(words, vocabulary), -FIRST_WORD)
    codes = codes.to_numpy(zero_copy_only=False).astype(np.int64) + FIRST_WORD
    # a sign by itself is no token, but it may end a sentence
    keep = np.flatnonzero(~empty[which])
    ends = np.concatenate([[0], np.cumsum(stop[which])])
    which, doc = which[keep], doc[keep]
    first = np.ones(len(keep), dtype=bool)
    if len(keep) > 1:
        first[1:] = (doc[1:] != doc[:-1]) | (ends[keep[1:]] > ends[keep[:-1]])
    plain = codes[which]
    out = plain.copy()
    out[title[which] & ~first] = NAME
    either = title[which] & first
    is_number = number[which]
    out[is_number] = NUM
    after = np.zeros(len(keep), dtype=bool)
    after[1:] = is_number[:-1] & (doc[1:] == doc[:-1])
    out[unit[which] & after & ~is_number] = UNIT
    either &= (out == 0) | (out >= FIRST_WORD)
    return Tokens(out, plain, doc, either, which, words)


def _forms(codes: np.ndarray, start: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Codes of windows, one row for each, with names at the places of ``mask``."""
    places = np.arange(WINDOW)
    return np.where(mask[:, None] >> places & 1, NAME, codes[start[:, None] + places])


def _windows(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, forms and hashes of the windows of known tokens inside one text, two words or more in each.

    The form is a mask of the places that are read as names, out of those that may be: every choice is there, if it leaves a word.
    """
    codes, doc = t.codes, t.doc
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    known = np.concatenate([[0], np.cumsum(codes > 0)])
    word = np.concatenate([[0], np.cumsum(codes >= FIRST_WORD)])
    inside = doc[WINDOW - 1 :] == doc[:n]
    start = np.flatnonzero((known[WINDOW:] - known[:-WINDOW] == WINDOW) & (word[WINDOW:] - word[:-WINDOW] >= 2) & inside)
    h = np.zeros(len(start), dtype=np.uint64)
    for k in range(WINDOW):
        h = _mix(h, codes[start + k])
    starts, masks, hashes = [start], [np.zeros(len(start), dtype=np.int64)], [h]
    bits = np.zeros(n, dtype=np.int64)
    for k in range(WINDOW):
        bits |= t.either[k : k + n].astype(np.int64) << k
    open_ = np.flatnonzero((bits > 0) & inside)
    bits = bits[open_]
    words = (codes >= FIRST_WORD) | t.either
    for mask in range(1, 1 << WINDOW):
        start = open_[bits & mask == mask]
        if len(start):
            form = _forms(codes, start, np.full(len(start), mask))
            good = (form > 0).all(axis=1) & (form >= FIRST_WORD).any(axis=1) & (words[start[:, None] + np.arange(WINDOW)].sum(axis=1) >= 2)
            start, form = start[good], form[good]
            h = np.zeros(len(start), dtype=np.uint64)
            for k in range(WINDOW):
                h = _mix(h, form[:, k])
            starts.append(start)
            masks.append(np.full(len(start), mask))
            hashes.append(h)
    return np.concatenate(starts), np.concatenate(masks), np.concatenate(hashes)


def _mix(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes.astype(np.uint64)) * _PRIME
    return h ^ h >> np.uint64(29)


def _runs(codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of ``n`` known tokens inside one text."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    powers, back = np.full((2, len(codes)), 1, dtype=np.uint64)
    powers[1:], back[1:] = _PRIME, _INVERSE
    powers, back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(np.zeros(len(codes), dtype=np.uint64), codes) * powers, dtype=np.uint64)])
    known = np.concatenate([[0], np.cumsum(codes > 0)])
    start = np.flatnonzero((known[n:] - known[:-n] == n) & (doc[n - 1 :] == doc[: len(doc) - n + 1]))
    return start, (sums[start + n] - sums[start]) * back[start]


def _readings(t: Tokens) -> list[np.ndarray]:
    """Codes of all tokens: as they are, with placeholders, and with sentence-initial names too."""
    return [t.plain, t.codes, np.where(t.either, NAME, t.codes)]


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each ``low`` to before each ``high``, one after the other."""
    size = high - low
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """Windows of benchmark items; picklable, so that it travels with the function that scans."""

    def __init__(self, items: list[tuple[int, str]]):
        import pyarrow as pa

        texts = pa.array([t or "" for _, t in items], pa.string())
        whole, _, _ = _distinct(texts)
        import pyarrow.compute as pc

        self.vocabulary = pc.utf8_lower(pc.utf8_trim(whole, characters=SIGNS)).unique().to_pylist()
        found = tokenise(texts, pa.array(self.vocabulary, pa.string()))
        self.items = [i for i, _ in items]
        self.codes, self.item = found.codes, found.doc
        self.values = [found.words[v].as_py() for v in found.values.tolist()]
        self.begin = np.searchsorted(found.doc, np.arange(len(items)))
        start, mask, h = _windows(found)
        order = np.argsort(h, kind="stable")
        self.hashes, self.starts, self.masks = h[order], start[order], mask[order]
        self.windows = np.bincount(found.doc[np.unique(start)], minlength=len(items))
        #: windows without which neither the share nor the run can be reached
        self.need = np.maximum(1, np.minimum(np.ceil(SHARE * self.windows), RUN - WINDOW + 1)).astype(np.int64)
        self._choose_keys()
        self.readings = _readings(found)
        #: by number of tokens and reading: sorted hashes of whole items, and the items
        self.whole: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.bincount(found.doc, minlength=len(items))
        few = (self.windows < FEW) & (sizes > 0)
        for n in np.unique(sizes[few]).tolist():
            of = np.flatnonzero(few & (sizes == n))
            for kind, codes in enumerate(self.readings if n >= WINDOW else self.readings[:1]):
                at, key = _runs(codes, found.doc, n)
                some = np.isin(at, self.begin[of])
                at, key = at[some], key[some]
                if kind and len(at):
                    # placeholders alone say nothing
                    some = (codes[at[:, None] + np.arange(n)] >= FIRST_WORD).any(axis=1)
                    at, key = at[some], key[some]
                if len(at):
                    order = np.argsort(key, kind="stable")
                    self.whole[n, kind] = key[order], found.doc[at][order]
        self.filter = np.zeros(1 << max(16, int(len(h)).bit_length() + 5), dtype=bool)
        self.filter[h & np.uint64(len(self.filter) - 1)] = True

    def _choose_keys(self) -> None:
        """Entries by item, and the hashes of the key windows with their items."""
        of = self.item[self.starts]
        self.by_item = np.argsort(of, kind="stable")
        self.bounds = np.searchsorted(of[self.by_item], np.arange(len(self.items) + 1))
        starts, where = np.unique(self.starts, return_inverse=True)
        # a window is as common as the most common of its forms; ranks tell all apart
        common = np.zeros(len(starts), dtype=np.int64)
        np.maximum.at(common, where, np.searchsorted(self.hashes, self.hashes, "right") - np.searchsorted(self.hashes, self.hashes))
        rank = np.empty(len(starts), dtype=np.int64)
        rank[np.argsort(common, kind="stable")] = np.arange(len(starts))
        # of w windows, w less those that a share needs may be missing: one more of the rarest can't be
        item, key = self.item[starts], np.zeros(len(starts), dtype=bool)
        order = np.lexsort((rank, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        spare = self.windows - np.ceil(SHARE * self.windows).astype(np.int64) + 1
        key[order[place < spare[item[order]]]] = True
        # the rarest of each run that would do by itself
        long = RUN - WINDOW + 1
        if len(starts) >= long:
            runs = np.flatnonzero(starts[long - 1 :] - starts[: len(starts) - long + 1] == long - 1)
            key[runs + np.lib.stride_tricks.sliding_window_view(rank, long)[runs].argmin(axis=1)] = True
        keys = key[where]
        self.key_hashes, self.key_items = self.hashes[keys], of[keys]

    def scan(self, texts) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text the items that it holds: item, its windows, windows found, longest run in tokens, changed slots."""
        import pyarrow as pa

        out: list[list] = [[] for _ in range(len(texts))]
        if not len(self.hashes) and not self.whole:
            return out
        found = tokenise(texts, pa.array(self.vocabulary, pa.string()))
        copies = self._copies(found)
        start, mask, h = _windows(found)
        maybe = self.filter[h & np.uint64(len(self.filter) - 1)]
        start, mask, h = start[maybe], mask[maybe], h[maybe]
        at = np.searchsorted(self.hashes, h)
        hit = at < len(self.hashes)
        hit[hit] = self.hashes[at[hit]] == h[hit]
        start, mask, h = start[hit], mask[hit], h[hit]
        order = np.argsort(start, kind="stable")
        start, mask, h = start[order], mask[order], h[order]
        doc = found.doc[start]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for some, masks, keys in zip(np.split(start, cuts), np.split(mask, cuts), np.split(h, cuts)):
            if len(some):
                out[found.doc[some[0]]] = self._items(found, some, masks, keys)
        for doc, items in copies.items():
            hits = {hit[0]: hit for hit in out[doc]}
            for item, (n, changed) in sorted(items.items()):
                hits[item] = (item, int(self.windows[item]), int(self.windows[item]), n, changed)
            out[doc] = [hits[item] for item in sorted(hits)]
        return [[(self.items[item], *hit) for item, *hit in hits] for hits in out]

    def _copies(self, found: Tokens) -> dict[int, dict[int, tuple[int, int]]]:
        """Items of few windows that stand in a text as a whole: for each text and item, its tokens and changed values (the least)."""
        out: dict[int, dict[int, tuple[int, int]]] = {}
        readings = _readings(found)
        for (n, kind), (hashes, items) in self.whole.items():
            codes = readings[kind]
            start, key = _runs(codes, found.doc, n)
            at = np.searchsorted(hashes, key)
            hit = at < len(hashes)
            hit[hit] = hashes[at[hit]] == key[hit]
            start, key = start[hit], key[hit]
            if not kind and len(start):
                # all places of a copy are alike
                _, first = np.unique(np.stack([found.doc[start].astype(np.uint64), key]), axis=1, return_index=True)
                start, key = start[first], key[first]
            for at, low, high in zip(start.tolist(), np.searchsorted(hashes, key).tolist(), np.searchsorted(hashes, key, "right").tolist()):
                for item in items[low:high].tolist():
                    own = int(self.begin[item])
                    if (self.readings[kind][own : own + n] != codes[at : at + n]).any():
                        continue
                    stands: dict[str, str] = {}
                    pairs = [(self.values[own + k], found.words[found.values[at + k].item()].as_py()) for k in np.flatnonzero(codes[at : at + n] < FIRST_WORD).tolist()]
                    if all(stands.setdefault(mine, theirs) == theirs for mine, theirs in pairs):
                        of = out.setdefault(int(found.doc[at]), {})
                        of[item] = min(of.get(item, (n, n)), (n, sum(mine != theirs for mine, theirs in stands.items())))
        return out

    def _items(self, found: Tokens, starts: np.ndarray, masks: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        distinct = np.unique(keys)
        led = np.unique(self.key_items[_spans(np.searchsorted(self.key_hashes, distinct), np.searchsorted(self.key_hashes, distinct, "right"))])
        at = self.by_item[_spans(self.bounds[led], self.bounds[led + 1])]
        place = np.searchsorted(distinct, self.hashes[at])
        at = at[distinct[np.minimum(place, len(distinct) - 1)] == self.hashes[at]]
        item, key = self.item[self.starts[at]], self.hashes[at]
        # items of which enough windows are there at all
        few = np.unique(self.starts[at])
        items, counts = np.unique(self.item[few], return_counts=True)
        enough = counts >= self.need[items]
        order = np.argsort(keys, kind="stable")
        ordered, out = keys[order], []
        for it in items[enough].tolist():
            own_at, own_key = at[item == it], key[item == it]
            low, high = np.searchsorted(ordered, own_key), np.searchsorted(ordered, own_key, "right")
            hit, own = order[_spans(low, high)], np.repeat(own_at, high - low)
            codes = _forms(found.codes, starts[hit], masks[hit])
            same = (codes == _forms(self.codes, self.starts[own], self.masks[own])).all(axis=1)
            best = self._best(it, found, starts[hit[same]], self.starts[own[same]], codes[same] < FIRST_WORD)
            if best:
                out.append((it, int(self.windows[it]), *best))
        return out

    def _best(self, item: int, found: Tokens, there: np.ndarray, own: np.ndarray, slot: np.ndarray) -> tuple[int, int, int] | None:
        """Windows found, run in tokens and changed values of the best occurrence of an item in a text, if one is enough.

        ``there`` and ``own`` are the starts of equal windows, ``slot`` the places in them that are placeholders.
        """
        order = np.lexsort((there, there - own))
        there, own, slot = there[order], own[order], slot[order]
        distance = there - own
        exact = np.unique(distance)
        ranges = [(np.searchsorted(distance, exact - more), np.searchsorted(distance, exact + more, "right"), False) for more in (0, SLACK)]
        places = np.arange(WINDOW)
        values = np.where(slot, found.values[there[:, None] + places], -1)
        best, seen = None, set()
        for lows, highs, whole in [*ranges, (np.array([0]), np.array([len(own)]), True)]:
            some = highs - lows >= self.need[item]
            for low, high in zip(lows[some].tolist(), highs[some].tolist()):
                if not whole:
                    # the same windows with the same values give the same
                    key = own[low:high].tobytes(), values[low:high].tobytes()
                    if key in seen:
                        continue
                    seen.add(key)
                windows: dict[int, set] = {}
                for o, s, v in zip(own[low:high].tolist(), slot[low:high], values[low:high].tolist()):
                    windows.setdefault(o, set()).add(tuple([(self.values[o + k], found.words[v[k]].as_py()) for k in np.flatnonzero(s).tolist()]))
                if len(windows) < self.need[item]:
                    continue
                passed, changed = self._consistent(windows, whole)
                run = longest = 0
                last = None
                for o in sorted(passed):
                    run = run + 1 if last is not None and o == last + 1 else 1
                    longest, last = max(longest, run), o
                if longest and (len(passed) >= SHARE * self.windows[item] or longest + WINDOW - 1 >= RUN):
                    best = max(best or (0, 0, 0), (len(passed), longest + WINDOW - 1, -changed))
                    if best == (self.windows[item], longest + WINDOW - 1, 0):
                        return best
        return best and (best[0], best[1], -best[2])

    def _consistent(self, windows: dict[int, set], whole: bool) -> tuple[set[int], int]:
        """Windows whose slots agree with what most windows let each value of the item stand for; values that changed."""
        votes: dict[str, dict[str, int]] = {}
        for found in windows.values():
            for mine, theirs in (pair for slots in found for pair in slots):
                of = votes.setdefault(mine, {})
                of[theirs] = of.get(theirs, 0) + 1
        # over a whole document, a value that is there unchanged stands for itself; in an occurrence, only in a tie
        stands = {mine: mine if whole and mine in of else min(of, key=lambda v: (-of[v], v != mine, v)) for mine, of in votes.items()}
        passed = {own for own, found in windows.items() if any(all(stands[mine] == theirs for mine, theirs in slots) for slots in found)}
        return passed, sum(mine != theirs for mine, theirs in stands.items())


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", index_chars: int = INDEX_CHARS) -> Iterator[Index]:
    """Indexes of at most about ``index_chars`` characters each (a single larger item has one to itself), one at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // index_chars))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    if parts > 1:
        items = materialise(items, "benchmark")
    for p in range(parts):
        yield Index([(r[0], r[1]) for r in items.where(F.col("part") == p).orderBy("item_id", "text").collect()])


HITS = "doc_id long, item_id long, windows int, found int, run_tokens int, changed_slots int"


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_chars: int = INDEX_CHARS) -> DataFrame:
    """One row per document and benchmark item that it holds.

    ``windows`` of the item, those ``found`` that pass, the longest run of them in tokens, and
    how many of its slot values stand for others.  Null and empty texts on either side hold
    nothing, nor do items of signs alone.  Items of fewer than ``WINDOW`` tokens are found as they are, not with other
    values (too little to tell).  Items of few windows are also found whole; then all windows count.  Repeated items
    are reported each; repeated documents too.  Whole texts are scanned.  Empty tables give no
    rows.  Other columns aren't read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in build_indexes(benchmark, index_chars=index_chars):
        found = docs.mapInArrow(_finder(df.sparkSession.sparkContext.broadcast(index)), HITS)
        out = found if out is None else out.union(found)
    return out


def _finder(index):
    def find(batches) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, 1024, 1):
            rows = [(doc, *hit) for doc, hits in zip(part.column(0).to_pylist(), index.value.scan(part.column(1))) for hit in hits]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "windows", "found", "run_tokens", "changed_slots"])

    return find


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", index_chars: int = INDEX_CHARS) -> DataFrame:
    """The rows of ``df``, unchanged, that hold no benchmark item; see :func:`find_leaks`.

    Null and empty texts stay, as do all rows where the benchmark is empty; repeated rows stay or go alike.
    """
    at = df.columns.index(text_col)

    def keeper(index):
        def keep(batches) -> Iterator:
            import pyarrow as pa

            for part in slices(batches, 1024, at):
                yield part.filter(pa.array([not hits for hits in index.value.scan(part.column(at))], pa.bool_()))

        return keep

    for index in build_indexes(benchmark, index_chars=index_chars):
        df = df.mapInArrow(keeper(df.sparkSession.sparkContext.broadcast(index)), df.schema)
    return df
