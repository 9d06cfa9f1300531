"""Token ids of whole texts by a public tokenizer, with its answers for single words kept."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable
from itertools import repeat
from operator import add
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from flowlens.llm.common import kept_in_worker

END = 1
#: The ways in which the two tokenizers cut text before merging (see their files).
WORD_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
BYTE_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space besides single blanks and line feeds between words (Arrow's regular expressions know ASCII in \s only).
ODD_SPACE = (
    r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LONGEST_KEPT = 48
#: So many new words are shown to the library in one line.
LINE = 512
MOST_WORDS, MOST_RUNS = 600_000, 100_000
#: So many characters of texts are looked up together.
TOGETHER = 1 << 20


class _Answers(dict):
    """Ids by word; a word not known yet gets an empty place, filled when the library has answered.

    Words of the dictionary before this one move here when they come again.
    """

    def __init__(self, before: dict[str, bytes]) -> None:
        self.before = before
        self.places: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytes | bytearray:
        ids = self.before.get(word)
        if ids is None:
            return self.places.setdefault(word, bytearray())
        self[word] = ids
        return ids

    def renewed(self, most: int) -> _Answers:
        """This one or, if it holds more than that, an empty one behind which only this one is kept."""
        if len(self) <= most:
            return self
        self.before = {}
        return _Answers(self)


class WordTokens:
    """Ids of texts, equal to those of the tokenizer on the whole texts.

    Both tokenizers cut a text into runs that never meet in a merge: at blanks, and between
    letters, digits and signs. So the ids of a text are the ids of its runs, and each worker
    asks the library for each run once. What is kept is bounded: of words, the last ``most`` new ones
    and as many before them stay.
    Added tokens such as '<|endoftext|>' have one id each and part the text before all else.
    """

    def __init__(self, path: str, most: int = MOST_WORDS) -> None:
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = self.tokenizer.normalizer is not None
        self.cut = regex.compile(WORD_RUNS if self.lower else BYTE_RUNS).findall
        self.plain = _Answers({})
        self.spaced = _Answers({})  # words behind a blank, without it, or behind a line feed, with it
        self.runs: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Tokens that end a word, or that begin one behind a blank.
        self.bounds = np.zeros(max(names.values()) + 1, bool)
        for name, number in names.items():
            self.bounds[number] = name.endswith("</w>") if self.lower else name.startswith("Ġ")
        self.signs = dict(zip(".,", self._ask([".", ","])))
        self.feed = self._ask(["\n"])[0]
        added = {t.content: number for number, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {a: np.array([added[a]], "<u4").tobytes() for a in sorted(added, key=len, reverse=True)}
        self.at_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not any(a in t for a in self.added for t in texts):
            return self._encode_plain(texts)
        split = [self.at_added(t) for t in texts]  # every other part is an added token
        found = iter(self._encode_plain([p for parts in split for p in parts[::2]]))
        return [b"".join([self.added[p] if i % 2 else next(found) for i, p in enumerate(parts)]) for parts in split]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without added tokens."""
        self.plain, self.spaced = self.plain.renewed(self.most), self.spaced.renewed(self.most)
        if self.lower:
            return self._encode_parts([self._word_parts(t) for t in texts])
        rows = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(rows, ODD_SPACE).to_pylist()
        cut = iter(self._encode_parts([self.cut(t) for t, o in zip(texts, odd) if o]))
        lines = iter(self._encode_lines([t for t, o in zip(texts, odd) if not o]))
        return [next(cut if o else lines) for o in odd]

    def _encode_parts(self, parts: list[list[str]]) -> list[bytes]:
        """The ids of texts cut into runs or words."""
        found = [list(map(self.plain.__getitem__, p)) for p in parts]
        self._fill()
        return [b"".join(ids) for ids in found]

    def _encode_lines(self, texts: list[str]) -> list[bytes]:
        """The ids of texts in which blanks and line feeds stand alone and between words.

        Texts are cut at blanks, each line's first word with the line feed before it (a text's
        first word gets one, taken off again). Of each different word the letters and the signs
        behind them, a run of their own, are looked up.
        """
        if not texts:
            return []
        lines = pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string())
        cut = pc.split_pattern(lines, " ")
        words = cut.values.dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        bare = [b if b.isalpha() else w for w, b in zip(names, map(str.rstrip, names, repeat(punctuation)))]
        found = list(map(self.spaced.__getitem__, bare))
        signs = list(map(self.plain.__getitem__, [w[len(b) :] for w, b in zip(names, bare)]))
        self._fill()
        ids = pa.array(list(map(add, found, signs)), pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[cut.offsets.to_numpy()].tolist()
        raw, skip = memoryview(ids.buffers()[2] or b""), len(self.feed)
        return [bytes(raw[a + skip : b]) for a, b in zip(ends, ends[1:])]

    def _fill(self) -> None:
        """Give the words not known yet their ids."""
        places = self.spaced.places
        heads = [(w, self.plain[w[1:]]) for w in places if w[:1] == "\n"]  # words that begin a line
        self._learn_places(self.plain, "")
        for word, ids in heads:
            places.pop(word).extend(self.feed + ids)
            self.spaced[word] = self.feed + ids
        self._learn_places(self.spaced, " ")

    def _learn_places(self, known: _Answers, blank: str) -> None:
        self._learn(known.places, blank, known)
        for word, place in known.places.items():
            place += known[word]
        known.places.clear()

    def _word_parts(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
        # a whole text's lower case of this letter depends on what follows, the tokenizer's does not
        text = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        return text.replace("\n", " ").split(" ")

    def _ask(self, runs: list[str]) -> list[bytes]:
        """The library's ids of runs."""
        out = []
        for begin in range(0, len(runs), 4096):
            got = self.tokenizer.encode_batch_fast(runs[begin : begin + 4096], add_special_tokens=False)
            out.extend([np.array(g.ids, "<u4").tobytes() for g in got])
        return out

    def _ask_words(self, stems: list[str], blank: str) -> list[bytes]:
        """The ids of words of letters, asked for in lines of many; their tokens tell where words meet."""
        if not self.lower and not blank:
            return self._ask(stems)
        lines = [stems[i : i + LINE] for i in range(0, len(stems), LINE)]
        texts = [blank + " ".join(line) for line in lines]
        out: list[bytes] = []
        for line, got in zip(lines, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            cuts = np.nonzero(self.bounds[ids])[0]
            if len(cuts) != len(line):  # a word that the tokenizer cuts itself
                out += self._ask([blank + w for w in line])
                continue
            raw = ids.tobytes()
            at = [0, *((cuts + 1) * 4).tolist()] if self.lower else [*(cuts * 4).tolist(), 4 * len(ids)]
            out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def _learn(self, words: Iterable[str], blank: str, known: _Answers) -> None:
        """Add words to ``known``: letters alone, letters and a sign behind them, or anything else."""
        stems, signed, others = set(), [], []
        for word in words:
            if word.isalpha():
                stems.add(word)
            elif word[-1:] in self.signs and word[:-1].isalpha():
                signed.append(word)
                if word[:-1] not in known and word[:-1] not in known.before:
                    stems.add(word[:-1])
            else:
                others.append(word)
        fresh = list(stems)
        known.update(zip(fresh, self._ask_words(fresh, blank)))
        known.update([(w, known[w[:-1]] + self.signs[w[-1]]) for w in signed])
        if len(self.runs) > MOST_RUNS:
            self.runs.clear()
        pieces = [(w, self.cut(blank + w)) for w in others]
        unknown = list({r for _, made in pieces for r in made}.difference(self.runs))
        letters = [r for r in unknown if r.startswith(blank) and r[len(blank) :].isalpha()]
        self.runs.update(zip(letters, self._ask_words([r[len(blank) :] for r in letters], blank)))
        signs = [r for r in unknown if r not in self.runs]
        self.runs.update(zip(signs, self._ask(signs)))
        known.update([(w, b"".join([self.runs[r] for r in made])) for w, made in pieces])
        for run in unknown:
            if len(run) > LONGEST_KEPT:
                del self.runs[run]


def encoded(batches, encode_all):
    """Documents of Arrow batches with the ids of their whole texts, in order; a null text is empty."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids.append(doc)
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held > TOGETHER:
                yield from zip(ids, encode_all(texts))
                ids, texts, held = [], [], 0
        yield from zip(ids, encode_all(texts))


def tokens(path: str, most: int = MOST_WORDS) -> WordTokens:
    """The tokenizer of a file, loaded once per worker."""
    return kept_in_worker(("tokens", path, most), lambda: WordTokens(path, most))
