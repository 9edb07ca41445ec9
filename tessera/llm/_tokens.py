"""Exact tokenizer results at dictionary speed.

Both public BPE files split a text at white space, and between a word and
the punctuation after it, before they merge; so a text's tokens are those of
its units. Each worker keeps a dictionary of units and asks the library for
the missing ones in batches; a text that isn't split that plainly goes to the
library whole.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np

from tessera.llm._common import kept

#: A worker's dictionary is emptied at this many units; that costs time only.
MAX_UNITS = 1_000_000
#: Texts whose missing units are encoded together.
SLICE = 200
#: Punctuation that ends a word; letters and digits never join with it.
TAIL = ".,;:!?%$&*#|"

#: Byte-level BPE shows each byte as a printable character: itself where it is one, else the next from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = str.maketrans({b: chr(b if b in SHOWN else 256 + sum(x not in SHOWN for x in range(b))) for b in range(256)})

_loaded: dict[tuple[type, str], object] = kept()


def _plain(word: str) -> bool:
    """Whether no library could see white space or a control character in the word, which has no space."""
    return word.isprintable()


class Units(dict):
    """key -> result of the library for that unit."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    @classmethod
    def of(cls, path: str):
        """This worker's dictionary for the file."""
        if (cls, path) not in _loaded:
            _loaded[cls, path] = cls(path)
        return _loaded[cls, path]

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fill(self, split: list[list[str]]) -> None:
        missing = set(chain.from_iterable(split)).difference(self)
        if len(self) + len(missing) > MAX_UNITS:
            self.clear()
            missing = set(chain.from_iterable(split))
        parts = {key: self.parts(key) for key in missing}
        new = [k for k in set(chain.from_iterable(parts.values())) if k not in self]
        # a word of letters is one piece to the library's splitter, so its model can be asked at once
        merge, whole = self.model.tokenize, []
        for key in new:
            if self.lettered(key):
                self[key] = self.value([t.id for t in merge(self.lead + (key if key.isascii() else key.encode().decode("latin-1").translate(SHOWN)))])
            else:
                whole.append(key)
        for key, ids in zip(whole, self.encoded([self.shown(k) for k in whole]), strict=True):
            self[key] = self.value(ids)
        for key, made in parts.items():
            if key not in self:
                self[key] = self.joined([self[k] for k in made])

    def parts(self, key: str) -> list[str]:
        """The keys that the library has to encode for this one."""
        core = key.rstrip(TAIL)
        return [core, "\2" + key[len(core) :]] if core != key and core[-1:].isalnum() else [key]


class ByteUnits(Units):
    """Counts for byte-level BPE that takes one space before a word along.

    A key is the word after a space; "\\0" before it stands for a line feed
    and "\\2" for nothing in place of the space.
    """

    #: how a space before a word is shown
    lead = " ".translate(SHOWN)
    MIXED = -(1 << 50)  # makes a sum negative: only the whole text can settle it

    def lettered(self, key: str) -> bool:
        return key.isalpha()

    def shown(self, key: str) -> str:
        lead = {"\0": "\n", "\2": ""}.get(key[:1])
        return " " + key if lead is None else lead + key[1:]

    def value(self, ids: list[int]) -> int:
        return len(ids)

    def joined(self, parts: list[int]) -> int:
        return sum(parts) if parts else self.MIXED

    def parts(self, key: str) -> list[str]:
        word = key[1:] if key[:1] in ("\0", "\2") else key
        return super().parts(key) if word and _plain(word) else []

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out: list[int] = []
        for at in range(0, len(texts), SLICE):
            some = texts[at : at + SLICE]
            split = [("\2" + t.replace("\n", " \0")).split(" ") if "\0" not in t and "\2" not in t else [] for t in some]
            self.fill(split)
            sums = [sum(map(self.__getitem__, x)) if x else self.MIXED for x in split]
            whole = iter(self.encoded([t for t, n in zip(some, sums, strict=True) if n < 0]))
            out += [n if n >= 0 else len(next(whole)) for n in sums]
        return out


class WordUnits(Units):
    """Little-endian 16-bit ids, for BPE that lower-cases and drops white space; a batch's texts are split and put together as Arrow columns."""

    def __init__(self, path: str):
        super().__init__(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer don't fit 16 bits")

    def lettered(self, key: str) -> bool:
        return key.isalpha() and (key.isascii() or key == key.lower() and unicodedata.is_normalized("NFC", key))

    def value(self, ids: list[int]) -> bytes:
        return array("H", ids).tobytes()

    def look_up(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct lower-case words."""
        out = list(map(self.get, keys))
        missing = [i for i, x in enumerate(out) if x is None]
        if len(self) + len(missing) > MAX_UNITS:
            self.clear()
            out, missing = [None] * len(keys), list(range(len(keys)))
        merge, lettered, whole = self.model.tokenize, self.lettered, []
        for i in missing:
            key = keys[i]
            core = key.rstrip(TAIL)
            if not lettered(core):
                whole.append(i)
                continue
            ids = self.get(core)
            if ids is None:
                # a word of letters is one piece to the library's splitter, so its model can be asked at once
                ids = self[core] = array("H", [t.id for t in merge(core if core.isascii() else core.encode().decode("latin-1").translate(SHOWN))]).tobytes()
            if len(core) < len(key):
                tail = key[len(core) :]
                end = self.get(tail)
                if end is None:
                    end = self[tail] = self.value(self.encoded([tail])[0])
                ids += end
            out[i] = self[key] = ids
        for i, ids in zip(whole, self.encoded([keys[i] for i in whole]), strict=True):
            out[i] = self[keys[i]] = self.value(ids)
        return out

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray] | list[bytes]:
        """The ids of an Arrow array's texts one after another, and how many each text has; of a list, the ids of each text as bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(texts, list):
            flat, n = self.ids(pa.array(texts, pa.string()))
            return [x.tobytes() for x in np.split(flat, np.cumsum(n)[:-1])] if texts else []
        # the library lower-cases each letter by itself, and this one grows
        low = pc.utf8_lower(pc.replace_substring(texts, "İ", "i̇") if pc.any(pc.match_substring(texts, "İ")).as_py() else texts)
        # special tokens are told by their case before that: a text with the like of one is encoded whole
        special = [pc.match_substring(low, t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        odd = np.flatnonzero(np.any([m.to_numpy(zero_copy_only=False) for m in special], axis=0)) if special else []
        split = pc.ascii_split_whitespace(low)
        words = split.flatten().dictionary_encode()
        made = pa.array(self.look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(words.indices)
        size = np.frombuffer(made.buffers()[1], np.int32)[made.offset : made.offset + len(made) + 1]
        ends = size[split.offsets.to_numpy() - split.offsets[0].as_py()] // 2
        data = made.buffers()[2]
        flat, n = np.frombuffer(data, "<u2", int(ends[-1])) if data is not None else np.zeros(0, "<u2"), np.diff(ends.astype(np.int64))
        if len(odd):
            each = np.split(flat, ends[1:-1])
            for i, ids in zip(odd, self.encoded(texts.take(pa.array(odd)).to_pylist()), strict=True):
                each[i] = np.array(ids, "<u2")
            flat, n = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        return flat, n
