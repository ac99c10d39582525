"""Encoding whole texts with the tokenizers library, remembering what words became.

Byte-level BPE cuts a text into pieces before it merges anything, and a single
space before other than white space always begins a piece. So a text's ids are
the ids of its space-separated words, one after another. Texts are cut and their
words numbered by Arrow, a bounded amount at a time; different words of ASCII and
Latin letters are cut by the vocabulary's published pattern, all in one pass, and
the library's model merges each piece that was not met of late. Words of anything
else go through the whole tokenizer. `tests/llm` hold this against encoding the
whole text at once.

The strings of special tokens inside a text are ordinary text, as the notes
beside the vocabulary files advise.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
#: Pieces that one worker remembers at most, about: those of late, and of the time before them. About 200 bytes each.
REMEMBERED = 1 << 19
#: Characters that are split into words at once, about.
AT_ONCE = 1 << 23

_ID = attrgetter("id")
_CUT = re.compile(r" (?=\S)")
#: A space beside other white space: there the split by single spaces does not hold.
_BESIDE = re.compile(r" \s")
#: What no word of ASCII and Latin letters holds; these characters are letters or not in any version of Unicode.
_OTHER = "[^\n!-~À-ÖØ-öø-ʯ]"
_LATIN = re.compile("[\n!-~À-ÖØ-öø-ʯ]*")
#: Fixed value: the published pattern of byte-level BPE, as it is for such words and single spaces before them.
_PIECES = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ʯ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[!-/:-@\\[-`{-~]+|\n+(?![^\n ])|\n+")


class _Memory(dict):
    """What `learn` makes of a key, remembered. What was not asked for since the last but one `age` is forgotten."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self._learn = learn
        self._old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self._old.get(key)
        if ids is None:
            ids = self._learn(key)
        self[key] = ids
        return ids

    def age(self) -> None:
        self._old = dict(self)
        self.clear()


class WordEncoder:
    def __init__(self, tokenizer_file: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._tokenizer.encode_special_tokens = True
        self._remembered = remembered
        size = self._tokenizer.get_vocab_size()
        #: Little-endian unsigned ids, as narrow as the vocabulary allows.
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._merge = self._tokenizer.model.tokenize
        self._bytes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        # How byte-level BPE spells bytes: printable ones as themselves, the others from U+0100 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = (b for b in range(256) if b not in plain)
        self._spelling = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}
        self._space = self._spelling[32]
        #: The ids of pieces, and of a space with a word that is not Latin.
        self._pieces = _Memory(self._piece)
        self._words = _Memory(lambda word: self._whole(" " + word))

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", self._space)
        else:
            spelled = piece.encode().decode("latin-1").translate(self._spelling)
        return b"".join(map(self._bytes.__getitem__, map(_ID, self._merge(spelled))))

    def _latin(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, _PIECES.findall(text)))

    def _head(self, head: str) -> bytes:
        """The ids of a text's first word, which no space begins."""
        return self._latin(head) if _LATIN.fullmatch(head) else self._whole(head)

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """The text, cut before words into parts of a bounded size."""
        at = 0
        while cut := _CUT.search(text, at + AT_ONCE):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes of `dtype`; texts are taken as far as a bounded amount of text needs."""
        out: list[list[bytes]] = []
        waiting: list[tuple[int, str]] = []
        size = 0
        for text in texts:
            out.append([])
            for part in self._parts(text):
                waiting.append((len(out) - 1, part))
                size += len(part)
                if size >= AT_ONCE:
                    self._encode(waiting, out)
                    waiting, size = [], 0
            if not waiting:
                yield from map(b"".join, out)
                out = []
        self._encode(waiting, out)
        yield from map(b"".join, out)

    def _encode(self, parts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        """Append each part's ids to its text's."""
        if not parts:
            return
        # Each part as words that a space begins, but for its head.
        apart = [p[-1:] == " " or _BESIDE.search(p) is not None for _, p in parts]
        words = pc.split_pattern(pa.array(["" if x else p for x, (_, p) in zip(apart, parts)], pa.large_string()), " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        flat = words.flatten()
        numbered = flat.dictionary_encode()
        place = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # Heads are numbered after all words, one for each part; words that are heads alone are not looked at.
        heads = flat.take(pa.array(bounds[:-1])).to_pylist()
        n_words = len(numbered.dictionary)
        place[bounds[:-1]] = n_words + np.arange(len(parts))
        used = np.bincount(place, minlength=n_words)[:n_words] > 0
        other = pc.match_substring_regex(numbered.dictionary, _OTHER).to_numpy(zero_copy_only=False)
        latin, rest = np.flatnonzero(used & ~other), np.flatnonzero(used & other)
        pieces = _PIECES.findall("".join([" " + w for w in numbered.dictionary.take(pa.array(latin)).to_pylist()]))
        known = list(map(self._pieces.__getitem__, pieces))
        size = len(known)
        known += map(self._words.__getitem__, numbered.dictionary.take(pa.array(rest)).to_pylist())
        known += map(self._head, heads)
        self._forget()
        of_piece = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        begins = np.flatnonzero([p[0] == " " for p in pieces])
        lengths = np.zeros(n_words + len(parts), np.int64)
        if len(begins):
            lengths[latin] = np.add.reduceat(of_piece[:size], begins)
        lengths[rest] = of_piece[size : size + len(rest)]
        lengths[n_words:] = of_piece[size + len(rest) :]
        # Where the ids of each word are: Latin words', then the others', then heads'.
        order = np.concatenate([latin, rest, np.arange(n_words, n_words + len(parts))])
        starts = np.zeros_like(lengths)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        ids = np.frombuffer(b"".join(known), self.dtype)
        n = lengths[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        all_ids = ids[np.repeat(starts[place] - ends[:-1], n) + np.arange(ends[-1])]
        for (i, part), odd, a, z in zip(parts, apart, ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist()):
            out[i].append(self._odd(part) if odd else all_ids[a:z].tobytes())

    def _odd(self, part: str) -> bytes:
        """The ids of a text that has white space beside a space, or a space at its end."""
        head, *words = _CUT.split(part)
        found = self._head(head) + b"".join([self._latin(" " + w) if _LATIN.fullmatch(w) else self._words[w] for w in words])
        self._forget()
        return found

    def _forget(self) -> None:
        if len(self._words) + len(self._pieces) > self._remembered // 2:
            self._words.age()
            self._pieces.age()


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(tokenizer_file: str, remembered: int = REMEMBERED) -> WordEncoder:
    """This worker's encoder: workers are reused, so what they remember serves later batches and tasks."""
    key = (tokenizer_file, remembered)
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


def default_tokenizer() -> str:
    """The file of the public 50k byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
