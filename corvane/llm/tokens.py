"""Byte-level BPE ids of whole texts with the tokenizers library, one encoding for each distinct word.

The pre-tokenizer of a byte-level BPE always starts a new piece at a single space between two non-space characters,
around a single line end between such, and where `,` or `.` follows a letter or digit. So the ids of a text are those
of its parts cut there, and every distinct part is encoded once per worker while it is remembered. A text with other
uses of these characters is cut at its plain spaces only.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Characters of texts that are encoded at once, but for longer texts; of those, every distinct part is looked up once.
CHUNK = 2 << 20
#: Words that are encoded in one text.
GROUP = 256
#: About what an entry of a dictionary and its objects take besides their text.
ENTRY = 190
#: What keeps a text from being cut everywhere: white space side by side, at an end or of other kinds, and stops after anything but a letter or digit.
_BESIDE = ("  ", "\n\n", " \n", "\n ")
_OTHER = tuple("\t\r\x00\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_STOP = re.compile(r"[.,](?<![^\W_][.,])")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_encoders: dict[str, Encoder] = {}


def _marked(text: str) -> str | None:
    """The text with a zero at each cut; none if it can't be cut everywhere."""
    if any(b in text for b in _BESIDE + _OTHER) or text[0] in " \n" or text[-1] in " \n" or _STOP.search(text):
        return None
    return text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0")


class Encoder:
    """keep: bytes of parts whose ids are remembered, in two generations, so that frequent parts stay."""

    def __init__(self, path: str, keep: int = 112 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.size, self.known, self.older = keep, 0, {}, {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized and self.tokenizer.normalizer for t in added):
            raise ValueError("added tokens that take more or less than their own text are not supported")
        self.added = sorted((t.content for t in added), key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        vocabulary = self.tokenizer.get_vocab()
        self.after_space = np.zeros(max(vocabulary.values()) + 1, bool)
        self.after_space[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.line_end = vocabulary["Ċ"]

    def parts(self, text: str) -> list[str]:
        """The text in parts that are encoded each by itself; added tokens, such as the end of a text, are parts of their own."""
        if any(t in text for t in self.added):
            pieces = self.at_added.split(text)
            return [p for i, piece in enumerate(pieces) if piece for p in ([piece] if i % 2 else self._cut(piece))]
        return self._cut(text) if text else []

    @staticmethod
    def _cut(text: str) -> list[str]:
        return marked.split("\0") if (marked := _marked(text)) else _CUT.split(text)

    def _split(self, texts: list[str]) -> tuple[pa.ListArray, np.ndarray]:
        """The parts of all texts, and at which place each text's are."""
        plain, other, place = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t and not any(a in t for a in self.added) and (m := _marked(t)):
                place[i] = len(plain)
                plain.append(m)
            else:
                place[i] = ~len(other)
                other.append(self.parts(t))
        place[place < 0] = len(plain) + ~place[place < 0]
        return pa.concat_arrays([pc.split_pattern(pa.array(plain, pa.large_string()), "\0"), pa.array(other, pa.list_(pa.large_string()))]), place

    def _learn(self, new: list[str]) -> None:
        """Ids of new parts. Words are encoded many in one text: each begins at a token with a space, or ends at a line end."""
        spaced, bare, other = [], [], []
        for p in new:
            word = p[1:] if p[:1] == " " else p
            (other if not word.isalpha() and word.split() != [word] or word in self.added else bare if word is p else spaced).append(p)
        for words, between in ((spaced, ""), (bare, "\n")):
            groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
            texts = [between.join(g) for g in groups]
            for group, text, e in zip(groups, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == self.line_end if between else self.after_space[ids])
                begins, ends = (np.append(0, cuts + 1), np.append(cuts, len(ids))) if between else (cuts, np.append(cuts[1:], len(ids)))
                if len(begins) != len(group):
                    other += group
                    continue
                whole = ids.tobytes()
                self.known.update(zip(group, [whole[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)], strict=True))
                self.size += ENTRY * len(group) + len(text) + len(whole)
        for p, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.known[p] = array("I", e.ids).tobytes()
            self.size += ENTRY + 4 * len(p) + 4 * len(e.ids)

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts."""
        if self.size > self.keep // 2:
            self.known, self.older, self.size = {}, self.known, 0
        found = list(map(self.known.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            p = parts[i]
            if (ids := self.older.get(p)) is None:
                new.append(p)
            else:
                self.known[p] = ids
                self.size += ENTRY + len(p) + len(ids)
        self._learn(new)
        for i in missing:
            found[i] = self.known[parts[i]]
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
        out, at = [], 0
        while at < len(texts):
            chunk, size = [], 0
            while at < len(texts) and size < CHUNK:
                chunk.append(texts[at] or "")
                at, size = at + 1, size + len(chunk[-1])
            parts, place = self._split(chunk)
            coded = parts.values.dictionary_encode()
            ids = pa.array(self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
            whole = pc.binary_join(pa.ListArray.from_arrays(parts.offsets, ids), pa.scalar(b"", pa.large_binary()))
            out += whole.take(pa.array(place)).to_pylist()
        return out


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
