"""Token ids of whole texts, word by word with a bounded memory of words seen before."""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioscope.llm.workers import memories

#: Words that a worker's two generations of memory hold each.
MOST_WORDS = 400_000
#: str.split also cuts at these, the tokenizers' white space does not hold them.
NOT_BLANK = "\x1c\x1d\x1e\x1f"
ENDING = frozenset(".,;:!?")
JOINED = 256
#: The pieces that the pre-tokenizer cuts a word of ``PLAIN`` characters into, and small letters that the normaliser leaves alone.
ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PLAIN = re.compile("[!-@\\[-~]+").fullmatch
LATIN = re.compile("[a-zªµºß-öø-ÿ]+").fullmatch
#: The characters that stand for the bytes 0 to 255 in the merges.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = "".join(chr(b) if b in _PRINTED else chr(0x100 + sum(c not in _PRINTED for c in range(b))) for b in range(256))

_encoders: dict[str, WordEncoder] = memories.setdefault("tokens", {})


def lowered(text: str) -> str:
    """The text in lower case, if the tokenizer's normaliser would surely do the same before it composes characters."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


def text_groups(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """``(first, number)`` of rows in a row that begin within the same ``most`` bytes of the column."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, prepend=-1))
    return list(zip(first.tolist(), np.diff(first, append=len(sizes)).tolist()))


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes, for a tokenizer that lowers case and never joins words across
    white space.

    Equal to encoding the text in one go: its normaliser maps characters on their own, its
    pre-tokenizer drops white space, and a closing mark after a letter or digit is a piece of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def letter_words(self, words: list[str]) -> list[bytes]:
        """``ids`` of words of letters only: joined texts are encoded, and cut by the words' numbers."""
        out = []
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            cuts = np.flatnonzero(np.diff(np.asarray(found.word_ids, np.int64), prepend=-1, append=-1)) * 4
            if len(cuts) != len(part) + 1:  # a letter that the normaliser takes apart
                out += self.ids(part)
                continue
            data, ends = np.asarray(found.ids, "<u4").tobytes(), cuts.tolist()
            out += [data[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def merged(self, part: str) -> bytes:
        """``ids`` of a piece of the pre-tokenizer that the normaliser leaves alone."""
        found = self.merges(part if part.isascii() and part.isprintable() else charmap_decode(part.encode(), "strict", BYTE_LEVEL)[0])
        return array("I", [token.id for token in found]).tobytes()

    def of_pieces(self, word: str) -> bytes:
        """``ids`` of a word of small ASCII letters, digits and marks: its pieces are encoded and remembered on their own."""
        young, out = self.young, []
        for piece in ASCII_PIECES.findall(word):
            data = young.get(piece)
            if data is None:
                data = young[piece] = self.old.get(piece) or self.merged(piece)
            out.append(data)
        return b"".join(out)

    def learn(self, words: list[str]) -> None:
        """Put ``words`` into the young memory; what it held before is old if it is full."""
        if len(self.young) + len(words) > MOST_WORDS:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        merged, of_pieces = self.merged, self.of_pieces
        parts, new = {}, {}
        for word in words:
            data = old.get(word)
            if data is not None:
                young[word] = data
            elif word.isascii():
                if word.islower() and word.isalpha():
                    young[word] = merged(word)  # as it is after the normaliser: straight to the merges
                elif PLAIN(word) and "<|" not in word:
                    young[word] = of_pieces(word)
                else:
                    new[word] = True
            elif word.isalpha():
                if LATIN(word):
                    young[word] = merged(word)
                else:
                    new[word] = True
            elif word[-1] in ENDING and (word[-2:-1].isalpha() or word[-2:-1].isdecimal()) and word[-2] != "İ" and "<|" not in word:
                stem = parts[word] = word[:-1]
                if stem in old:
                    young[stem] = old[stem]
                elif LATIN(stem) and stem.isalpha():
                    young[stem] = merged(stem)
                else:
                    new[stem] = True
            else:
                new[word] = True
        letters = [p for p in new if p.isalpha()]
        others = [p for p in new if not p.isalpha()]
        young.update(zip(letters, self.letter_words(letters)))
        young.update(zip(others, self.ids(others)))
        young.update({word: young[stem] + of_pieces(word[-1]) for word, stem in parts.items()})

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of each of the distinct ``words``."""
        data = list(map(self.young.get, words))
        missing = [w for w, d in zip(words, data) if d is None]
        if missing:
            self.learn(missing)
            young = self.young
            data = [young[w] if d is None else d for w, d in zip(words, data)]
        return data

    def encode(self, texts: list[str]) -> list[bytes]:
        """``ids`` of every text: its words are told apart in Arrow, each different one is looked up once."""
        odd = [any(c in text for c in NOT_BLANK) for text in texts]
        split = pc.utf8_split_whitespace(pa.array(["" if o else lowered(t) for o, t in zip(odd, texts)], pa.string()))
        words = split.flatten().dictionary_encode()
        data = self.known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        flat, first, word = np.frombuffer(b"".join(data), "<u4"), np.cumsum(sizes) - sizes, words.indices.to_numpy()
        many = sizes[word]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(first[word] - ends[:-1], many) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [self.ids([text])[0] if o else ids[a:b].tobytes() for text, o, a, b in zip(texts, odd, cuts, cuts[1:])]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
