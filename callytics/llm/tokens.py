"""Exact token ids of whole texts, with the ids of repeated text segments remembered.

Byte-level BPE splits a text into words before it merges bytes. A place between a character that is no
white space and a following blank or line end always lies between two words, whatever stands further
left or right: a word holds white space at its start only. So does a place between a letter or digit and a mark that isn't an apostrophe. A text
may therefore be cut there, each segment encoded alone and the ids joined. Words repeat, so most segments are found in
the memory of the worker.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from callytics.llm.common import worker_memory

DEFAULT_TOKENIZER = "byte_bpe_50k.json"

#: White space other than blank, tab and line ends. A run that ends in one is not cut after it.
_OTHER_SPACE = "\x0b\x0c\x1c-\x1f\x85\xa0  -     　"
_MARKS = r".,!?;:*#%&$|"
SEGMENT = re.compile(
    rf"[ \t\n\r]*[^\W_]+(?=[ \t\n\r{_MARKS}])|[{_MARKS}]+(?=[ \t\n\r])|"
    rf"[ \t\n\r]*[^ \t\n\r]+(?:(?<=[{_OTHER_SPACE}])[ \t\n\r]+[^ \t\n\r]*)*|[ \t\n\r]+"
)

#: Places where a text may be cut.
SAFE_CUT = re.compile(rf"(?<=[^ \t\n\r{_OTHER_SPACE}])(?=[ \t\n\r])")

#: Where a blank follows on white space; a text with such places, or with white space at its end, isn't split at blanks.
WIDE = re.compile(r" (?<=\s )")
#: A full stop or comma before a blank is split off as a word of its own, with a sign that the text must not hold, and so
#: is a full stop with the line end after it. That is safe where they stand after a letter or digit and no white space
#: follows the line end.
ALONE = "\x01"
UNSAFE_LINE = re.compile(r"\n\s")
UNSAFE_MARK = re.compile(rf" {ALONE}[.,](?<=[\W_] {ALONE}[.,])")
#: A word of Latin letters.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

#: Segments a worker remembers, twice: when full, they become the old ones and are kept until it is full again. At most
#: about 200 bytes each, as longer ones than LONG characters are not remembered. Results do not depend on it.
REMEMBERED = 800_000
LONG = 64

#: Bytes of text that are cut into segments at once.
CHUNK = 8 << 20
#: Characters up to which it is faster to count the ids of texts one by one.
FEW = 8 << 10
#: Segments that are one word of the tokenizer.
WORD = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@[-`{-~]+)")
#: The code points that byte-level vocabularies write for bytes: visible ones stand for themselves, others count from 256.
SIGNS = np.arange(256, dtype="<u4")
_UNSEEN = [*range(33), *range(127, 161), 173]
SIGNS[_UNSEEN] = 256 + np.arange(len(_UNSEEN))

#: Classes of bytes: blank, other line and tab space, letter, digit, mark, apostrophe, end of any other character that is
#: surely no white space; ANY is everything else.
ANY, BLANK, SPACE, LETTER, DIGIT, MARK, QUOTE, DARK = range(8)


def _classes() -> np.ndarray:
    kinds = np.full(256, ANY, np.uint8)
    for code in range(0x21, 0x7F):
        kinds[code] = LETTER if chr(code).isalpha() else DIGIT if chr(code).isdigit() else MARK
    kinds[list(b"\t\n\r")] = SPACE
    kinds[ord(" ")], kinds[ord("'")] = BLANK, QUOTE
    return kinds


def _cuts() -> np.ndarray:
    """Whether a text may be cut between bytes of two classes, by 8 * first + second."""
    cut = np.zeros((8, 8), bool)
    cut[LETTER:, [BLANK, SPACE]] = True
    # Not behind an apostrophe, which takes letters with it, and not between marks.
    for first, second in ((LETTER, DIGIT), (LETTER, MARK), (LETTER, QUOTE), (DIGIT, MARK), (DIGIT, QUOTE)):
        cut[first, second] = True
    cut[DIGIT, LETTER] = cut[MARK, LETTER] = cut[MARK, DIGIT] = True
    return cut.ravel()


CLASSES, CUTS = _classes(), _cuts()
#: Last bytes of the white space among characters that begin with these bytes, and of others.
WIDE_SPACE = np.isin(np.arange(256), [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
MAYBE_SPACE = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])


def segment_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where segments begin in the UTF-8 bytes of texts that lie one behind the other and begin at `texts`."""
    kinds = CLASSES[data]
    heads = np.flatnonzero(data >= 0xC2)
    if len(heads):
        lead = data[heads]
        two = heads[lead < 0xE0]
        code = (data[two].astype(np.int32) & 31) << 6 | data[two + 1] & 63
        latin = (code >= 0xC0) & (code < 0x250) & (code != 0xD7) & (code != 0xF7)
        kinds[two + 1] = np.where(latin, LETTER, np.where(code > 0xA0, DARK, ANY))
        kinds[two[latin]] = LETTER
        three = heads[(lead >= 0xE0) & (lead < 0xF0)]
        kinds[three + 2] = np.where(MAYBE_SPACE[data[three]] & WIDE_SPACE[data[three + 2]], ANY, DARK)
        kinds[heads[lead >= 0xF0] + 3] = DARK
    cut = np.ones(len(data), bool)
    cut[1:] = CUTS[kinds[:-1] << 3 | kinds[1:]]
    # A line end alone between other characters is a word of its own.
    space = np.flatnonzero(kinds == SPACE)
    space = space[(space > 0) & (space < len(data) - 1)]
    after = kinds[space + 1]
    cut[space[(kinds[space - 1] >= LETTER) & (after >= LETTER) & (after < DARK)] + 1] = True
    cut[texts[texts < len(data)]] = True
    return np.flatnonzero(cut)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def safe_parts(text: str, size: int) -> list[str]:
    """A text in parts of `size` characters or a little more, cut at safe places."""
    out, at = [], 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


class Memory(dict):
    """Segment -> its ids as little-endian unsigned 32-bit integers; bounded."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def known(self, segment: str) -> bytes | None:
        data = self.get(segment)
        if data is None and (data := self.old.get(segment)) is not None:
            self.keep(segment, data)
        return data

    def keep(self, segment: str, data: bytes) -> bytes:
        if len(segment) <= LONG:
            self.room()
            self[segment] = data
        return data

    def room(self) -> None:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts, as the tokenizer's own `encode` gives them with add_special_tokens=False.

    The name of an added token in a text gives that token, as there. Such names hold no blank, so no cut falls into one.
    Most texts are split at blanks, and before a full stop or comma. Words that are not known are encoded together.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens with white space would be cut")
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that begin with a blank or a line end.
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] in "\u0120\u010a"]] = True
        #: Words go straight to the merges where nothing else would change them.
        plain = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.model = self.tokenizer.model if plain else None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Memory()  # by the segment without the blank in front of it
        self.bare = Memory()

    def _encoded(self, segment: str) -> bytes:
        return array("I", self.tokenizer.encode(segment, add_special_tokens=False).ids).tobytes()

    def _segment(self, segment: str) -> bytes:
        if segment[0] == " " and segment[1:2] != ALONE:
            return self._word(segment[1:])
        data = self.bare.known(segment)
        return self.bare.keep(segment, self._encoded(segment)) if data is None else data

    def _word(self, word: str) -> bytes:
        """Ids of a blank and the word, or of marks alone."""
        data = self.words.known(word)
        if data is None and word[:1] == ALONE:
            data = self.words.keep(word, self._segment(word[1:]))
        elif data is None:
            parts = SEGMENT.findall(f" {word}")
            data = self._encoded(parts[0]) if len(parts) == 1 else b"".join(map(self._segment, parts))
            self.words.keep(word, data)
        return data

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that were not found, those of letters, also with marks behind them, in one call."""
        old = self.words.old
        spaced: dict[str, bytes | None] = {}  # letters after a blank
        bare: dict[str, bytes | None] = {}  # letters that begin a line
        made: list[tuple[str, dict, str, str]] = []
        for word in words:
            if len(word) > LONG or word in old:
                continue
            stem = word.rstrip(_MARKS)
            if stem[:1] == ALONE:
                letters, stems, memory = stem[1:], bare, self.bare
            else:
                letters, stems, memory = stem, spaced, self.words
            if letters.isalpha() and letters.isascii() or PLAIN.fullmatch(letters):
                if letters not in stems:
                    stems[letters] = memory.get(letters)
                made.append((word, stems, letters, word[len(stem) :]))
        self._encode_letters(spaced, bare)
        found = {w: stems[letters] + self._segment(marks) if marks else stems[letters] for w, stems, letters, marks in made}
        self.words.room()
        self.words.update(found)
        if len(found) < len(words):
            for word in words:
                if word not in found:
                    found[word] = self._word(word)
        return found

    def _encode_letters(self, spaced: dict[str, bytes | None], bare: dict[str, bytes | None]) -> None:
        """Give words of letters their ids, after a blank or at the begin of a line, where they have none."""
        blank, line = ([w for w, data in words.items() if data is None] for words in (spaced, bare))
        if not blank and not line:
            return
        # A word of letters is one word of the tokenizer, with the blank before it or behind a line end.
        text = "".join([*[f" {w}" for w in blank], *[f"\n{w}" for w in line]])
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        data, begins = ids.tobytes(), np.flatnonzero(self.begins[ids])
        if len(begins) != len(blank) + len(line):
            raise ValueError("the tokenizer cuts words of letters")
        begin, end = (4 * begins).tolist(), (4 * np.append(begins[1:], len(ids))).tolist()
        n = len(blank)
        spaced.update({w: data[i:j] for w, i, j in zip(blank, begin, end)})
        bare.update({w: data[i + 4 : j] for w, i, j in zip(line, begin[n:], end[n:])})

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text; a null text is empty."""
        if not text:
            return b""
        if text[-1].isspace() or ALONE in text or WIDE.search(text):
            return b"".join(map(self._segment, SEGMENT.findall(text)))
        cut = text.replace(". ", f" {ALONE}. ").replace(", ", f" {ALONE}, ")
        if not UNSAFE_LINE.search(text):
            cut = cut.replace(".\n", f" {ALONE}.\n {ALONE}")
        if cut[0] == " " != text[0] or UNSAFE_MARK.search(cut):
            cut = text
        first, *words = cut.split(" ")
        parts = list(map(self.words.get, words))
        unknown = [i for i, data in enumerate(parts) if data is None]
        if unknown:
            new = self._learn(list(dict.fromkeys([words[i] for i in unknown])))
            for i in unknown:
                parts[i] = new[words[i]]
        return b"".join(map(self._segment, SEGMENT.findall(first))) + b"".join(parts)

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // 4

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow column. Texts are cut together, and each different segment is looked up once."""
        return self._each(texts, self._chunk, self.ids, b"".join)

    def counts(self, texts: Iterable[str]) -> Iterator[int]:
        """Number of ids of each text, found as in `batch` for texts of about CHUNK characters at once; few are cut alone."""
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._each(pa.array(some, pa.large_string()), self._chunk_counts, self.count, sum)
                some, size = [], 0
        if size <= FEW:
            yield from map(self._count_alone, some)
        else:
            yield from self._each(pa.array(some, pa.large_string()), self._chunk_counts, self.count, sum)

    def _count_alone(self, text: str) -> int:
        """Number of ids of a short text, with the memory of `batch`."""
        if any(name in text for name in self.added):
            return self.count(text)
        segments = SEGMENT.findall(text)
        found = list(map(self.bare.get, segments))
        if None in found:
            unknown = list(dict.fromkeys([s for s, ids in zip(segments, found) if ids is None]))
            new = dict(zip(unknown, self._learn_segments(unknown)))
            found = [new[s] if ids is None else ids for s, ids in zip(segments, found)]
        return sum(map(len, found)) // 4

    def _each(self, texts: pa.Array, chunk: Callable, one: Callable, join: Callable) -> list:
        """What `chunk` gives for many texts and `one` for a text with an added token; `join` puts parts of a text together."""
        texts = texts.cast(pa.large_string()).fill_null("")
        out: list = []
        if not len(texts):
            return out
        _, ends, data = texts.buffers()
        places = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        bytes_ = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        while (first := len(out)) < len(texts):
            last = max(first + 1, int(np.searchsorted(places, places[first] + CHUNK, side="right")) - 1)
            part = bytes_[places[first] : places[last]]
            halves = safe_parts(texts[first].as_py(), CHUNK) if len(part) > CHUNK else []
            if len(halves) > 1:
                out.append(join(self._each(pa.array(halves), chunk, one, join)))
            elif any(name.encode() in part.tobytes() for name in self.added):
                some = [(t, any(name in t for name in self.added)) for t in texts[first:last].to_pylist()]
                others = [t.encode() for t, named in some if not named]
                begin = np.cumsum([0, *map(len, others)], dtype=np.int64)[:-1]
                rest = iter(chunk(np.frombuffer(b"".join(others), np.uint8), begin))
                out += [one(t) if named else next(rest) for t, named in some]
            else:
                out += chunk(part, places[first:last] - places[first])
        return out

    def _segments(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Which of the different segments stand in texts that lie one behind the other, where those of each text and of
        the end begin among them, and the ids of the different ones."""
        begin = segment_starts(data, texts)
        ends = pa.py_buffer(np.append(begin, len(data)))
        segments = pa.Array.from_buffers(pa.large_string(), len(begin), [None, ends, pa.py_buffer(data)]).dictionary_encode()
        different = segments.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.bare.get, different))
        unknown = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unknown, self._learn_segments([different[i] for i in unknown])):
            found[i] = ids
        return segments.indices.to_numpy(), np.searchsorted(begin, np.append(texts, len(data))), found

    def _chunk(self, data: np.ndarray, texts: np.ndarray) -> list[bytes]:
        """Ids of texts without added tokens that lie one behind the other, by their places."""
        if not len(data):
            return [b""] * len(texts)
        index, first, found = self._segments(data, texts)
        ids = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(n) - n
        each = n[index]
        end = np.cumsum(each)
        place = np.repeat(start[index] - end + each, each)
        place += np.arange(len(place))
        all_ids = ids[place].tobytes()
        cut = 4 * np.append(0, end)[first]
        return [all_ids[i:j] for i, j in zip(cut.tolist(), cut[1:].tolist())]

    def _chunk_counts(self, data: np.ndarray, texts: np.ndarray) -> list[int]:
        """The same for their numbers."""
        if not len(data):
            return [0] * len(texts)
        index, first, found = self._segments(data, texts)
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.diff(np.append(0, np.cumsum(n[index]))[first]).tolist()

    def _learn_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of different segments that are not in the newer memory."""
        found = list(map(self.bare.old.get, segments))
        new = [i for i, ids in enumerate(found) if ids is None]
        words = [i for i in new if self.model and len(segments[i]) <= LONG and WORD.fullmatch(segments[i])]
        if words:
            # One word each, so no splitting is needed. No word holds a line end.
            data = np.frombuffer("\n".join([segments[i] for i in words]).encode(), np.uint8)
            signs = SIGNS[data].tobytes().decode("utf-32-le").split(chr(SIGNS[ord("\n")]))
            for i, tokens in zip(words, map(self.model.tokenize, signs)):
                found[i] = array("I", [t.id for t in tokens]).tobytes()
        for i in new:
            if found[i] is None:
                found[i] = self._encoded(segments[i])
        self.bare.room()
        self.bare.update([(s, ids) for s, ids in zip(segments, found) if len(s) <= LONG])
        return found


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer."""
    return worker_memory(f"tokens {path}", lambda: Encoder(path))


def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about CHUNK bytes, where they are smaller."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, size = [], 0
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def batch_encoder(path: str) -> Encoder:
    """The same for `batch` and `counts`, whose memory is another."""
    return worker_memory(f"token batches {path}", lambda: Encoder(path))
