"""Byte-level BPE ids through the tokenizers library, with a bounded cache of pre-token pieces."""

from __future__ import annotations

import os
from array import array

#: What a text that is cut at spaces may not hold: anything but line feeds and printable Latin-1, runs of white space; and the empty text.
_ODD = r"[^\n\x20-\x7e\x{a1}-\x{ff}]|[ \n][ \n]|^$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str | None = None):
    """The library's tokenizer; the strings of special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path or default_path())
    tok.encode_special_tokens = True
    return tok


class Encoder:
    """Texts to 32-bit ids.

    Byte-level BPE merges only within a piece of the pre-token pattern, so a stretch of whole pieces has
    the same ids wherever it stands. In a text of printable Latin-1 characters (on whose classes all
    Unicode versions agree) whose white space is single spaces and line feeds, a piece can start at a
    space or a line's start but never run across one. Arrow cuts such texts into words, finds the distinct
    ones of a batch and looks them up among the words already known; the library encodes the others, each
    with its space or line feed; ids are laid out by array indexing. All other texts go to the library
    whole. Of more than ``max_entries`` known words those not used for longest are dropped, so memory is
    bounded by them and a batch, and results never depend on what is held.
    """

    def __init__(self, path: str | None = None, max_entries: int = 400_000, max_word: int = 40, tok=None):
        self.tok = tok or load(path)
        self.end = b""
        self._reset()
        self.feed, self.blank = self._ids(["\n", " "])
        self.mark = {c: self._ids([c])[0] for c in ".,"}
        self.max_entries, self.max_word = max_entries, max_word

    def _reset(self) -> None:
        import numpy as np
        import pyarrow as pa

        self.words = pa.array([], pa.string())  # known words; word i has ids flat[start[i]:start[i] + size[i]]
        self.flat, self.start, self.size, self.used = np.zeros(0, "<i4"), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.clock = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], most: int = 20_000) -> list[bytes]:
        """Ids of each word, many in one call: line feeds, whose id no word holds, part them. The library needs some hundred bytes a word, hence ``most``."""
        import numpy as np

        if not words:
            return []
        if len(words) > most:
            return [x for at in range(0, len(words), most) for x in self._joined(words[at : at + most])]
        ids = np.array(self.tok.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<i4")
        raw, cuts = ids.tobytes(), np.flatnonzero(ids == np.frombuffer(self.feed, "<i4")[0]) * 4
        return [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)]

    def _find(self, words):
        """Places of words among the known ones, -1 for none."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().copy()

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of new words. A word begins with a line feed, or with a carriage return at a text's start; any other stands behind a space.

        A full stop or comma behind a letter or digit is a piece of its own, so such words are made of
        the bare word's ids.
        """
        import pyarrow as pa

        ends = {w: w[:-1] for w in words if w[-1:] in (".", ",") and w[-2:-1].isalnum()}
        got = {"": self.blank, "\v": self.end}
        bases = list(set(ends.values()))
        for w, at in zip(bases, self._find(pa.array(bases, pa.string())).tolist(), strict=True):
            if at >= 0:
                got[w] = self.flat[self.start[at] : self.start[at] + self.size[at]].tobytes()
        bare = [w for w in {*words, *bases} if w not in got and w not in ends]
        later = [w for w in bare if w[0] not in "\n\r"]
        got.update(zip(later, self._joined([" " + w for w in later]), strict=True))
        for lead, before in (("\n", self.feed), ("\r", b"")):
            some = [w for w in bare if w[0] == lead]
            full = [w for w in some if len(w) > 1]
            got.update((w, before) for w in some if len(w) == 1)
            got.update((w, before + x) for w, x in zip(full, self._joined([w[1:] for w in full]), strict=True))
        return [got[ends[w]] + self.mark[w[-1]] if w in ends else got[w] for w in words]

    def _forget(self) -> None:
        """Keep the half that was used last, without long words."""
        import numpy as np
        import pyarrow as pa

        n = self.max_entries // 2
        keep = np.flatnonzero(self.used > np.partition(self.used, len(self.used) - n)[len(self.used) - n] - 1) if len(self.used) > n else np.arange(len(self.used))
        keep = keep[np.argsort(-self.used[keep], kind="stable")][:n]
        keep = keep[self.size[keep] <= self.max_word]
        size = self.size[keep].astype(np.int64)
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.start[keep] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.words, self.start, self.size, self.used = self.words.take(pa.array(keep)), ends - size, self.size[keep], self.used[keep]

    def _places(self, words):
        """Places of distinct words, after learning those not known."""
        import numpy as np
        import pyarrow as pa

        self.clock += 1
        if len(self.words) > self.max_entries:
            self._forget()
        at = self._find(words)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            got = self._encoded(fresh.to_pylist())
            size = np.fromiter(map(len, got), np.int32, len(got)) // 4
            at[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, fresh])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size, dtype=np.int64) - size])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(got), "<i4")])
            self.size, self.used = np.concatenate([self.size, size]), np.concatenate([self.used, np.zeros(len(new), np.int32)])
        self.used[at] = self.clock
        return at

    def _plain(self, texts, end_id: int | None):
        """Two arrays over texts that can be cut: where each text's ids start, and the ids. The end id stands for a last word that no text holds."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\r", texts, "" if end_id is None else " \v", ""), "\n", " \n"), " ")
        if isinstance(cut, pa.ChunkedArray):
            cut = cut.combine_chunks()
        coded = cut.flatten().dictionary_encode()
        at = self._places(coded.dictionary)
        which = coded.indices.to_numpy()
        per = self.size[at][which]
        ends = np.cumsum(per, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total + len(self.flat) < 1 << 30 else np.int64
        ids = self.flat[np.repeat(self.start[at].astype(kind)[which] - (ends - per).astype(kind), per) + np.arange(total, dtype=kind)]
        words = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return np.concatenate([[0], ends])[words], ids

    def encode(self, texts, end_id: int | None = None):
        """(starts, ids) of an Arrow array of texts, null as empty: text i's ids are ids[starts[i]:starts[i + 1]], ``end_id`` last where given."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        end = b"" if end_id is None else array("i", [end_id]).tobytes()
        if end != self.end:
            self.end = end
            self._reset()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            starts, ids = self._plain(texts, end_id) if len(texts) else (np.zeros(1, np.int64), np.zeros(0, "<i4"))
        else:
            starts, ids = self._plain(texts.filter(pa.array(~odd)), end_id) if not odd.all() else (np.zeros(1, np.int64), np.zeros(0, "<i4"))
            whole = iter([x + self.end for x in self._ids(texts.filter(pa.array(odd)).to_pylist())])
            cut = iter(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
            parts = [np.frombuffer(next(whole), "<i4") if o else ids[slice(*next(cut))] for o in odd]
            starts, ids = np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
        return starts, ids


_encoders: dict = {}


def encoder(path: str | None = None, max_entries: int = 400_000) -> Encoder:
    """One per Python worker and vocabulary file; ``max_entries`` bounds its memory at some fifty bytes a word."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].max_entries = max_entries
    return _encoders[path]


def release() -> None:
    """Drop what this worker has cached for encoding."""
    from vellum.llm import common

    _encoders.clear()
    common.give_back()


def id_lists(starts, ids):
    """An Arrow list<int32> column over the ids, without a Python object per id."""
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.asarray(starts, np.int32)), pa.array(ids))


def slices(batch, rows: int = 512):
    """An Arrow batch in pieces, so that what Python holds at once stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
