"""Token ids of whole texts, by the public word BPE tokenizer.

That tokenizer never builds a token across white space or across the border between letters
and other signs: its normaliser turns runs of white space into one space and lower-cases, its
splitter cuts texts into runs of letters, single digits and runs of other signs, and each run
is encoded by itself, its last token marked as a word's end.  So the ids of a text are the ids
of its runs, one after another, and a cache from runs to ids saves most of the encoding.
White-space-separated chunks are taken apart here only where that is beyond doubt (letters of
``LETTERS`` between ASCII signs, no apostrophe); all others go to the tokenizer as they are.
Only ASCII white space separates chunks.  Splitting, finding distinct chunks and runs, and
putting ids together are done by Arrow and numpy; Python looks at each distinct run of a batch.

The strings of special tokens in a text are those tokens, as in the tokenizer's plain call, unless
``literal`` asks for them as ordinary text.  The tokenizer cuts a text at them before all else, so
they are cut out here too, and what lies between is encoded like a text of its own.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

END_ID = 2
#: Runs that a worker keeps; with them it stays within about 300 MB.
RUNS = 300_000
#: ASCII signs but the apostrophe, which the splitter treats on its own.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that are lower-case, composed and alone in their run of letters.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_SIGNS, _LETTERS = frozenset(SIGNS), frozenset(LETTERS)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Cache:
    """A bounded dict: what came first stays, as common entries come early, and later ones are
    let go after use; when many have been turned away (the material has changed) it starts anew."""

    def __init__(self, entries: int):
        self.known: dict[str, bytes] = {}
        self.entries, self.turned_away = entries, 0

    def let_go(self, new: list[str]) -> None:
        if len(self.known) > self.entries:
            self.turned_away += len(new)
            if self.turned_away > 20 * self.entries:
                self.known.clear()
                self.turned_away = 0
            else:
                for key in new:
                    del self.known[key]


class RunEncoder:
    """Encodes text columns to unsigned 32-bit ids; one per Python worker."""

    def __init__(self, path: str, runs: int = RUNS, literal: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = json.loads(self.tokenizer.to_str())["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that depend on what surrounds them are not supported")
        self.special = {} if literal else {t["content"]: t["id"] for t in added}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})")
        # texts come without special tokens' strings; lower-casing might make some
        self.tokenizer.encode_special_tokens = True
        # for runs, which are normal already and joined by spaces
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.runs = Cache(runs)

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Plain runs by one call, cut after each token that ends a word."""
        (e,) = self.plain.encode_batch_fast([" ".join(runs)], add_special_tokens=False)
        ids = np.array(e.ids, dtype="<u4")
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(runs):
            return self._encode_each(runs)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, runs: list[str]) -> None:
        known = self.runs.known
        plain = [r for r in runs if (r.isascii() and r.isalpha() and r.islower()) or _LETTERS.issuperset(r) or _SIGNS.issuperset(r)]
        other = [] if len(plain) == len(runs) else list(set(runs).difference(plain))
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            known.update(zip(some, self._encode_runs(some)))
        if other:
            known.update(zip(other, self._encode_each(other)))

    def encode(self, texts, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string column, each followed by ``end_id``, and the ids of each text.

        Null reads as empty.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        if not any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.special):
            return self._encode_plain(texts, end_id)
        # parts between special tokens, each followed by the token after it
        parts = [self.cut.split(t) for t in texts.to_pylist()]
        after = [x for p in parts for x in (*(self.special[t] for t in p[1::2]), end_id)]
        ids, sizes = self._encode_plain(pa.array([t for p in parts for t in p[::2]], pa.string()), end_id)
        ids = ids.copy()
        ids[np.cumsum(sizes) - 1] = after
        counts = np.array([len(p) // 2 + 1 for p in parts])
        return ids, np.add.reduceat(sizes, np.cumsum(counts) - counts)

    def _encode_plain(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without nulls in which no special token counts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        # lower-casing ASCII first changes no id, and makes fewer chunks
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        ends = chunks.offsets.to_numpy()[1:] - chunks.offsets[0].as_py()
        coded = chunks.flatten().dictionary_encode()
        whole = coded.dictionary
        # signs, letters, signs; a chunk that is not of that kind is left whole
        led, trailed = pc.ascii_ltrim(whole, SIGNS), pc.ascii_rtrim(whole, SIGNS)
        core, head, tail = pc.ascii_rtrim(led, SIGNS), pc.utf8_rtrim(trailed, LETTERS), pc.utf8_ltrim(led, LETTERS)
        fits = pc.equal(pc.binary_length(whole), pc.add(pc.add(pc.binary_length(head), pc.binary_length(core)), pc.binary_length(tail)))
        fits = pc.and_(fits, pc.equal(pc.utf8_ltrim(core, LETTERS), ""))
        core, head, tail = pc.if_else(fits, core, whole), pc.if_else(fits, head, ""), pc.if_else(fits, tail, "")
        parts = pa.chunked_array([head, core, tail]).combine_chunks().dictionary_encode()
        runs, known = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), self.runs.known
        found = list(map(known.get, runs))
        if unknown := [i for i, ids in enumerate(found) if ids is None]:
            missing = [runs[i] for i in unknown]
            self._learn(missing)
            for i, r in zip(unknown, missing):
                found[i] = known[r]
            self.runs.let_go(missing)
        flat = np.frombuffer(b"".join(found) + np.array([end_id], dtype="<u4").tobytes(), dtype="<u4")
        sizes = np.append(np.fromiter(map(len, found), np.int64, len(found)) // 4, [1, 0])
        starts = np.cumsum(sizes) - sizes
        n = len(whole)
        of = np.zeros((n + 1, 3), dtype=np.int32)
        of[:n] = parts.indices.to_numpy().reshape(3, n).T
        of[n] = len(runs), len(runs) + 1, len(runs) + 1  # the end of a text
        which = of[np.insert(coded.indices.to_numpy(), ends, n)].ravel()
        long = sizes[which]
        at = np.cumsum(long)
        place = np.repeat(starts[which] - (at - long), long)
        place += np.arange(len(place))
        last = at[3 * (ends + np.arange(len(ends))) + 2]
        return flat[place], np.diff(last, prepend=0)


_ENCODERS: dict[tuple[str, bool], RunEncoder] = {}


def encoder(path: str, literal: bool = False) -> RunEncoder:
    if (path, literal) not in _ENCODERS:
        _ENCODERS[path, literal] = RunEncoder(path, literal=literal)
    return _ENCODERS[path, literal]
