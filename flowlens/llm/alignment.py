"""Alignment of the tokens of two tokenizers over the bytes of the same texts."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.durable import Scratch
from flowlens.llm.common import kept_in_worker, leave_nothing_kept

MARK = "▁"
#: Texts of so many characters make a chunk; a longer text is a chunk of its own.
CHUNK = 1 << 21
MOST_KEPT = 500_000
#: Groups with more pairs than this are counted id by id before they are paired.
SMALL_GROUP = 1 << 12
#: Above every pair's code, so that a document's number and a code make one integer.
SPAN = 1 << 32
#: So many words are shown to the libraries in one line.
LINE = 512
#: Both tokenizers end a token before a blank or line feed that follows a visible character.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
ODD_SPACE = re.compile(r"[^\S \n]")


def odd(text: str) -> bool:
    """Whether a text has white space other than single blanks and line feeds between words."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
        return True
    return not text.replace("\n", "").isprintable() and ODD_SPACE.search(text) is not None


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the characters from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class TokenPair:
    """Both tokenizers, with their answers for words kept.

    A text is cut where both always end a token, so the tokens of a text are those of its words.
    Ids of the second tokenizer are held above those of the first, so that one array has both.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=True)
        self.base = max(names.values()) + 1
        self.bytes = [b""] * self.base
        for name, number in names.items():
            self.bytes[number] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        for number, piece in enumerate(pieces):
            is_byte = self.b.is_byte(number)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(MARK, " ").encode())
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.begins = np.array([x[:1] in (b" ", b"\n") for x in self.bytes])
        self.mark = self.base + self.b.piece_to_id(MARK)
        visible = [p.lstrip(MARK) for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        # words are independent if no piece goes on behind a visible character into the next word
        self.apart = not any(MARK in p or " " in p or "\n" in p for p in visible)
        self.words: dict[str, tuple[bytes, bytes] | None] = {}
        self.odd: dict[str, tuple[bytes, bytes] | None] = {}
        signs = ",|;"
        #: Ids as they are written, by 3 * id and the sign behind them.
        self.written = [f"{i - self.base if i >= self.base else i}{x}" for i in range(len(self.bytes)) for x in signs]

    def _ask(self, chunks: list[str], texts: list[str], skip: int = 0) -> list[tuple[bytes, bytes] | None]:
        """Both libraries' ids; ``texts`` go to the second, whose first ``skip`` pieces are left out.

        None where the bytes of the tokens are not those of the chunk.
        """
        first = [g.ids for g in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        second = self.b.encode(texts, num_threads=1)
        out: list[tuple[bytes, bytes] | None] = []
        of_a, of_b = self.bytes.__getitem__, self.bytes[self.base :].__getitem__
        for chunk, a, b in zip(chunks, first, second):
            want, b = chunk.encode(), b[skip:] if skip else b
            right = b"".join(map(of_a, a)) == want and b"".join(map(of_b, b)) == want
            out.append((array("i", a).tobytes(), array("i", [self.base + x for x in b]).tobytes()) if right else None)
        return out

    def _learn_plain(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of chunks of one blank or line feed and visible characters each.

        Many chunks behind one another are a text like any other, in which every chunk's first
        token is told by its first byte. So the libraries see lines of chunks, not each alone.
        """
        lines = [chunks[i : i + LINE] for i in range(0, len(chunks), LINE)]
        texts = [" a" + "".join(line) for line in lines]
        second = self.b.encode([t[1:] for t in texts], num_threads=1)
        first = [g.ids for g in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[tuple[bytes, bytes] | None] = []
        for line, text, *sides in zip(lines, texts, first, second):
            want, parts = text.encode(), []
            for ids, base in zip(sides, (0, self.base)):
                ids = np.array(ids, "<i4") + np.int32(base)
                cuts = np.nonzero(self.begins[ids])[0]
                if len(cuts) != len(line) + 1 or b"".join(map(self.bytes.__getitem__, ids.tolist())) != want:
                    break
                raw, at = ids.tobytes(), (cuts * 4).tolist() + [4 * len(ids)]
                parts.append([raw[x:y] for x, y in zip(at[1:], at[2:])])
            out += zip(*parts) if len(parts) == 2 else self._learn(line)
        return out

    def _learn(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of chunks, each a blank or line feed and what follows; None where bytes differ."""
        out: list[tuple[bytes, bytes] | None] = [None] * len(chunks)
        for skip in (0, 1):
            some = [i for i, c in enumerate(chunks) if (c[0] == "\n") == skip and c != " "]
            asked = [chunks[i] for i in some]
            for i, ids in zip(some, self._ask(asked, [c[1 - skip :] for c in asked], skip)):
                out[i] = ids
        if " " in chunks:
            ids = self.a.encode(" ", add_special_tokens=False).ids
            out[chunks.index(" ")] = (array("i", ids).tobytes(), array("i", [self.mark]).tobytes())
        return out

    def _known(self, parts: list[list[str]], known: dict, plain: bool) -> None:
        if len(known) > MOST_KEPT:
            known.clear()
        fresh = list({w for part in parts for w in part}.difference(known))
        for begin in range(0, len(fresh), 1 << 14):
            some = fresh[begin : begin + (1 << 14)]
            if plain:
                known.update(zip(some, self._learn_plain([w if w[0] == "\n" else " " + w for w in some])))
            else:
                known.update(zip(some, self._learn(some)))

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a text as the libraries see it; none if their bytes are not the text's."""
        return self._ask([" " + text], [text])[0] or (b"", b"")

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of each text by both tokenizers; none where a text is empty or its bytes change."""
        plain, unusual = [], []
        for i, text in enumerate(texts):
            if text and self.apart:
                (unusual if odd(text) else plain).append(i)
        words = [texts[i].replace("\n", " \n").split(" ") for i in plain]
        chunks = [CUT.split(" " + texts[i]) for i in unusual]
        a, b = [b""] * len(texts), [b""] * len(texts)
        for numbers, parts, known in ((plain, words, self.words), (unusual, chunks, self.odd)):
            self._known(parts, known, known is self.words)
            for i, part in zip(numbers, parts):
                found = list(map(known.__getitem__, part))
                if None in found:
                    a[i], b[i] = self._whole(texts[i])
                else:
                    a[i], b[i] = map(b"".join, zip(*found))
        if not self.apart:
            for i, text in enumerate(texts):
                if text:
                    a[i], b[i] = self._whole(text)
        return a, b


def token_pair(path_a: str, path_b: str) -> TokenPair:
    return kept_in_worker(("token pair", path_a, path_b), lambda: TokenPair(path_a, path_b))


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of these sizes, the number of the range and the place in it of every element."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Split intervals of tokens at shared ends until none is left inside; returns the leaf groups.

    ``roots`` and the result have a row (first A, behind last A, first B, behind last B) each, and
    both last tokens of a row end at one byte. An interval is halved at the shared end nearest its
    middle: the A end in the middle is looked up among the B ends by bisection, then those around
    it in rings of doubling reach. All intervals of a depth go together, so there are about as
    many passes as the logarithm of the longest text, and an interval without a shared end costs
    one look at each of its ends.
    """
    leaves, now = [], roots
    while len(now):
        single = (now[:, 1] - now[:, 0] == 1) | (now[:, 3] - now[:, 2] == 1)
        leaves.append(now[single])
        now = now[~single]
        middle = (now[:, 0] + now[:, 1] - 2) // 2
        found = np.searchsorted(ends_b, ends_a[middle])
        hit = ends_b[found] == ends_a[middle]
        cut_a, cut_b = np.where(hit, middle, -1), np.where(hit, found, -1)
        seeking, ring = np.nonzero(~hit & (now[:, 1] - now[:, 0] > 2))[0], (1, 2)
        while len(seeking):
            near, far = ring
            at = middle[seeking]
            lowest, highest = now[seeking, 0], now[seeking, 1] - 2  # the last end is no cut
            below = np.maximum(at - near - lowest + 1, 0).clip(max=far - near + 1)
            above = np.maximum(highest - at - near + 1, 0).clip(max=far - near + 1)
            owner, place = spread(below + above)
            low = place < below[owner]
            distance = near + np.where(low, place, place - below[owner])
            place = at[owner] + np.where(low, -distance, distance)
            found = np.searchsorted(ends_b, ends_a[place])
            hit = np.nonzero(ends_b[found] == ends_a[place])[0]
            order = hit[np.lexsort((distance[hit], owner[hit]))]
            first = np.ones(len(order), bool)
            first[1:] = owner[order[1:]] != owner[order[:-1]]
            best = order[first]
            cut_a[seeking[owner[best]]] = place[best]
            cut_b[seeking[owner[best]]] = found[best]
            more = (cut_a[seeking] < 0) & ((at - far > lowest) | (at + far < highest))
            seeking, ring = seeking[more], (far + 1, 2 * far + 1)
        whole = cut_a < 0
        leaves.append(now[whole])
        now, a, b = now[~whole], cut_a[~whole] + 1, cut_b[~whole] + 1
        left = np.column_stack([now[:, 0], a, now[:, 2], b])
        right = np.column_stack([a, now[:, 1], b, now[:, 3]])
        now = np.concatenate([left, right])
    groups = np.concatenate(leaves) if leaves else roots[:0]
    return groups[np.argsort(groups[:, 0], kind="stable")]


def linked(a: np.ndarray, b: np.ndarray, groups: np.ndarray, doc_of: np.ndarray, width: int) -> tuple:
    """The id pairs linked in each document: arrays (document, a * width + b, times), in order."""
    n_a, n_b = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    small = n_a * n_b <= SMALL_GROUP
    owner, place = spread((n_a * n_b)[small])
    at = groups[small]
    pairs = a[at[owner, 0] + place // n_b[small][owner]] * width + b[at[owner, 2] + place % n_b[small][owner]]
    keys, times = np.unique(doc_of[small][owner] * SPAN + pairs, return_counts=True)
    if not small.all():
        more, often = [keys], [times]
        for group, doc in zip(groups[~small], doc_of[~small]):
            (ids_a, of_a), (ids_b, of_b) = (
                np.unique(x, return_counts=True) for x in (a[group[0] : group[1]], b[group[2] : group[3]])
            )
            more.append((ids_a[:, None] * width + ids_b).ravel() + doc * SPAN)
            often.append((of_a[:, None] * of_b).ravel())
        keys, inverse = np.unique(np.concatenate(more), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, inverse, np.concatenate(often))
        times = total
    return keys // SPAN, keys % SPAN, times


class Chunk:
    """The alignment of some texts that one worker handles together."""

    def __init__(self, pair: TokenPair, texts: list[str]) -> None:
        both = pair.encode(texts)
        self.n_a, self.n_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in both)
        a, b = (np.frombuffer(b"".join(ids), "<i4").astype(np.int64) for ids in both)
        stops_a, stops_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        some = np.nonzero(self.n_a)[0]
        roots = np.column_stack([(stops_a - self.n_a)[some], stops_a[some], (stops_b - self.n_b)[some], stops_b[some]])
        self.groups = shared_cuts(np.cumsum(pair.sizes[a]), np.cumsum(pair.sizes[b]), roots)
        self.doc_of = np.searchsorted(stops_a, self.groups[:, 0], side="right")
        self.n_groups = np.bincount(self.doc_of, minlength=len(texts))
        self.a, self.b, self.base, self.names = a, b - pair.base, pair.base, pair.written
        links = linked(self.a, self.b, self.groups, self.doc_of, len(pair.bytes) - pair.base)
        self.doc, code, self.times = links
        self.code, self.at, self.docs = np.unique(code, return_inverse=True, return_counts=True)
        self.width = len(pair.bytes) - pair.base
        self.n_links = np.bincount(self.doc, weights=self.times, minlength=len(texts)).astype(np.int64)

    def written(self) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``, ids in decimals."""
        n_a, n_b = self.groups[:, 1] - self.groups[:, 0], self.groups[:, 3] - self.groups[:, 2]
        before = np.cumsum(n_a + n_b) - n_a - n_b
        out = np.empty(len(self.a) + len(self.b), np.int64)
        for ids, sizes, start, behind in ((self.a, n_a, before, 1), (self.b + self.base, n_b, before + n_a, 2)):
            owner, place = spread(sizes)
            last = place == sizes[owner] - 1
            out[start[owner] + place] = ids * 3 + np.where(last, behind, 0)
        stops = np.cumsum(self.n_a + self.n_b).tolist()
        texts = list(map(self.names.__getitem__, out.tolist()))
        return ["".join(texts[begin:stop])[:-1] for begin, stop in zip([0, *stops], stops)]


DOC_FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
CHUNK_SCHEMA = pa.schema([
    ("chunk", pa.int64()),
    *[(f, pa.int64()) for f in DOC_FIELDS],
    ("groups", pa.string()),
    ("groups_sha256", pa.string()),
    ("at", pa.list_(pa.int32())),
    ("times", pa.list_(pa.int32())),
    ("pos", pa.int32()),
    ("a", pa.int32()),
    ("b", pa.int32()),
    ("docs", pa.int64()),
])
SPARK_SCHEMA = (
    "chunk bigint, " + ", ".join(f"{f} bigint" for f in DOC_FIELDS)
    + ", groups string, groups_sha256 string, at array<int>, times array<int>, pos int, a int, b int, docs bigint"
)


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in CHUNK_SCHEMA], schema=CHUNK_SCHEMA
    )


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def aligned_chunks(path_a: str, path_b: str, with_groups: bool, size: int):
    """A function for ``mapInArrow``: rows of documents and rows of a chunk's different id pairs."""

    def rows(pair: TokenPair, number: int, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(pair, texts)
        written = chunk.written()
        digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
        sizes = np.bincount(chunk.doc, minlength=len(texts))
        columns = {f: pa.array(getattr(chunk, f), pa.int64()) for f in DOC_FIELDS[1:]}
        if with_groups:
            columns["groups"] = pa.array(written, pa.string())
        yield _batch(
            len(texts), chunk=pa.array([number] * len(texts), pa.int64()), doc_id=pa.array(ids, pa.int64()),
            groups_sha256=pa.array(digests), at=_lists(chunk.at, sizes), times=_lists(chunk.times, sizes), **columns,
        )
        n = len(chunk.code)
        for begin in range(0, n, 1 << 16):
            code = chunk.code[begin : begin + (1 << 16)]
            yield _batch(
                len(code), chunk=pa.array(np.full(len(code), number)),
                pos=pa.array(np.arange(begin, begin + len(code)), pa.int32()),
                a=pa.array(code // chunk.width, pa.int32()), b=pa.array(code % chunk.width, pa.int32()),
                docs=pa.array(chunk.docs[begin : begin + (1 << 16)], pa.int64()),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                if held and held + len(text) > size:
                    yield from rows(pair, number, ids, texts)
                    ids, texts, held, number = [], [], 0, number + 1
                ids.append(doc)
                texts.append(text)
                held += len(text) + 1
        if ids:
            yield from rows(pair, number, ids, texts)

    return run


def counted_links(chunks: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents each id pair is linked; best of its a id."""
    counts = chunks.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("count"))
    most = F.max("count").over(Window.partitionBy("a"))
    return counts.select("a", "b", "count", (F.col("count") == most).alias("best"))


def _scored(docs: pa.Table, links: pa.Table) -> pa.Table:
    """Documents of one chunk with sums over their links."""
    leave_nothing_kept()
    docs, n = docs.combine_chunks(), docs.num_rows
    count, best = np.zeros(links.num_rows, np.int64), np.zeros(links.num_rows, np.int64)
    pos = links.column("pos").to_numpy()
    count[pos] = links.column("count").to_numpy()
    best[pos] = links.column("best").to_numpy()
    at, times = (docs.column(c).combine_chunks() for c in ("at", "times"))
    at, times = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (at, times))
    sizes = np.diff(at.offsets.to_numpy())
    owner = np.repeat(np.arange(n), sizes)
    at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = []
    for values in (times * best[at], times * count[at]):
        total = np.zeros(n, np.int64)
        np.add.at(total, owner, values)
        sums.append(pa.array(total))
    kept = docs.select([*DOC_FIELDS, "groups", "groups_sha256"])
    return kept.append_column("n_best", sums[0]).append_column("count_sum", sums[1])


OUT_SCHEMA = (
    ", ".join(f"{f} bigint" for f in DOC_FIELDS) + ", groups string, groups_sha256 string, n_best bigint, count_sum bigint"
)


def align_tokens(
    docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, chunk_size: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """Align byte-level BPE tokens (A) and SentencePiece tokens (B) of every whole text.

    Returns one row per row of ``docs`` (doc_id, text) and the table of linked id pairs (a, b,
    count, best). A text is split at the byte offsets where tokens of both end: at the shared end
    nearest the middle, found by bisection, then both halves again; what has no shared end inside
    is a group. All A and B tokens of a group are linked. ``count`` is the number of documents
    (rows) that hold a pair linked, ``best`` marks the pairs of highest count of their A id.
    ``with_groups`` adds the groups as text ``a1,a2|b1;a3|b2,b3``.

    Texts are read in chunks of bounded size. A chunk is written down once, with its documents and
    its different id pairs; pairs are summed per chunk before the shuffle, so that the commonest
    pair has one row per chunk. The counts come back to the chunks by a join on both ids and meet
    the documents there. Nothing of all documents passes the driver or is broadcast.

    A null or empty text, or one whose bytes a tokenizer changes, has no tokens: zeros and ''.
    Special tokens in texts are plain text. A null doc_id stays null; repeated rows count as
    documents of their own; other columns play no part; an empty table gives no rows. A very long
    text is a chunk of its own. Ids of a long group are counted before they are paired, so that
    it costs its different pairs.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    source = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    chunks = scratch.keep(source.mapInArrow(aligned_chunks(path_a, path_b, with_groups, chunk_size), SPARK_SCHEMA))
    links = counted_links(chunks)
    pairs = chunks.where("a IS NOT NULL").select(F.col("chunk").alias("part"), "pos", "a", "b")
    back = pairs.join(links, ["a", "b"]).select("part", "pos", "count", "best")
    held = chunks.where("at IS NOT NULL").select("chunk", *DOC_FIELDS, "groups", "groups_sha256", "at", "times")
    scored = held.groupBy("chunk").cogroup(back.groupBy("part")).applyInArrow(_scored, OUT_SCHEMA)
    return (scored if with_groups else scored.drop("groups")), links
