"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse."""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import pieces, texts_of

#: Fixed value: the public pattern by which byte-level BPE vocabularies of this kind split a text before merging.
#: \s is spelled out as the White_Space property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters of a text that are fed at a time, and characters after a piece that may still change where it ends.
CHUNK, LOOKAHEAD = 1 << 16, 4
#: A piece that is still unfinished at this many characters is fed on as it comes; others are fed whole.
LONG = 256
#: Pieces whose tokens are remembered.
REMEMBERED = 600_000
NEVER = 1 << 60


def _byte_names() -> dict[str, int]:
    """The printable stand-ins by which such vocabularies spell bytes: printable Latin-1 stays, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        vocab, model = spec["model"]["vocab"], spec["model"]
        raw = lambda s: bytes(names[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            if t not in self.special:
                self.bytes_of[i] = raw(t)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.unit = [vocab[c] for c, _ in sorted(names.items(), key=lambda x: x[1])]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.joined = [vocab[a + b] for a, b in merges]
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in merges])
        self.pattern = regex.compile(PIECES)
        kinds = (r"\p{L}+", r"\p{N}+", r"[^\p{White_Space}\p{L}\p{N}]+", r"\p{White_Space}+")
        self.runs = [(regex.compile(p if k == 3 else " ?" + p), regex.compile(p), k == 3) for k, p in enumerate(kinds)]
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.special_reach = max(map(len, self.special), default=1) - 1
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.known: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merge list to a sequence of units: the earliest merge first, from left to right.

        A merge makes only pairs that come later in the list. So a long sequence takes all places of the best pair in one pass;
        in a short one the ranks beside a merge are all that is looked up again."""
        rank, joined = self.rank.get, self.joined
        while len(ids) > 64:
            best = min(map(rank, zip(ids, ids[1:]), repeat(NEVER)))
            if best == NEVER:
                return ids
            new, out, i, last = joined[best], [], 0, len(ids) - 1
            while i <= last:
                if i < last and rank((ids[i], ids[i + 1])) == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        ranks = list(map(rank, zip(ids, ids[1:]), repeat(NEVER)))
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i] = joined[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
        return ids

    def pack(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def encode(self, text: str) -> Iterator[bytes]:
        """Token ids of a text (32 bits each, little-endian), in runs as they become stable."""
        stream = Encoder(self)
        last = max(0, len(text) - 1) // CHUNK * CHUNK
        for at in range(0, last, CHUNK):
            yield stream.push(text[at : at + CHUNK])
        yield stream.push(text[last:] if last else text, last=True)

    def decode(self, runs: Iterable[bytes]) -> Iterator[str]:
        """Text of runs of token ids, as far as it is complete: a state machine holds the bytes of an unfinished character; bytes
        that no character has become U+FFFD."""
        machine, of = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of
        for ids in runs:
            yield machine.decode(b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]))
        yield machine.decode(b"", True)


class Transducer:
    """The tokens of one piece, whose bytes come in parts. A token is emitted once `lookahead` bytes follow it: no later byte can then
    change it. What is held never exceeds four lookaheads and one part."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.held = codec, b""

    def push(self, part: bytes) -> bytes:
        codec = self.codec
        self.held += part
        if len(self.held) < 4 * codec.lookahead:
            return b""
        stable, n, out = len(self.held) - codec.lookahead, 0, []
        for i in codec.merge([codec.unit[b] for b in self.held]):
            if n + len(codec.bytes_of[i]) > stable:
                break
            out.append(i)
            n += len(codec.bytes_of[i])
        self.held = self.held[n:]
        return codec.pack(out)

    def end(self) -> bytes:
        """The piece is whole: all the rest is stable."""
        codec, held, self.held = self.codec, self.held, b""
        return codec.pack(codec.merge([codec.unit[b] for b in held]))


class Encoder:
    """A text in parts of any size, to token ids as they become stable: the one way by which texts are encoded.

    What is held: characters in which a special token may still be open, characters that don't yet make a piece (fewer than LONG
    + LOOKAHEAD besides the part), and the Transducer's bytes. A piece goes through the Transducer, whole once it is known to
    end, or, from LONG characters on, as it comes. What the Transducer made of a whole piece is remembered.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec, self.inner = codec, Transducer(codec)
        self.open = ""  # may still be part of a special token
        self.text = ""  # not yet cut into pieces
        self.run: tuple | None = None  # the kind of the piece that is fed as it comes
        self.bytes = codecs.getincrementaldecoder("utf-8")("surrogatepass")

    def holds(self) -> int:
        return len(self.open) + len(self.text) + len(self.inner.held)

    def push(self, part: str | bytes, last: bool = False) -> bytes:
        """Ids that are stable after this part; all, if it is the last."""
        part = self.bytes.decode(part, last) if isinstance(part, bytes) else part
        codec = self.codec
        if not codec.special_pattern:
            return b"".join(self._feed(part, last))
        text, out, at = self.open + part, [], 0
        for m in codec.special_pattern.finditer(text):
            out += self._feed(text[at : m.start()], True)
            out.append(codec.packed[codec.special[m[0]]])
            at = m.end()
        stop = len(text) if last else max(at, len(text) - codec.special_reach)
        self.open = text[stop:]
        out += self._feed(text[at:stop] if at or self.open else text, last)
        return b"".join(out)

    def _feed(self, part: str, last: bool) -> list[bytes]:
        """Cut into pieces; last: the text, or what comes before a special token, ends here."""
        text, out, known = self.text + part if self.text else part, [], self.codec.known.get
        while True:
            if self.run:
                more, text = self._go_on(text, last)
                out.append(more)
                if self.run:
                    break
            found = self.codec.pattern.findall(text)
            if last:
                text = ""
            else:
                # a piece counts only if enough follows; the others are found again
                stop = len(text)
                while found and stop > len(text) - LOOKAHEAD:
                    stop -= len(found.pop())
                text = text[stop:]
            pieces_ = list(map(known, found))
            out += [ids or self._whole(piece) for ids, piece in zip(pieces_, found, strict=True)] if None in pieces_ else pieces_
            if len(text) < LONG:
                break
            self.run = next(r for r in self.codec.runs if (m := r[0].match(text)) and m.end() > len(text) - LOOKAHEAD)
            head = 0 if self.run[2] else 1  # one character at least, and a space before other kinds
            out.append(self.inner.push(text[:head].encode("utf-8", "surrogatepass")))
            text = text[head:]
        self.text = text
        return out

    def _go_on(self, text: str, last: bool) -> tuple[bytes, str]:
        """Feed what goes on with the long piece; its tokens, and the text that is left."""
        _, kind, blank = self.run
        m = kind.match(text)
        end = m.end() if m else 0
        over = end < len(text) or last
        # the last white space goes with what follows, if anything does
        stop = end - 1 if blank and end and not (last and end == len(text)) else end
        out = self.inner.push(text[:stop].encode("utf-8", "surrogatepass"))
        if over:
            out += self.inner.end()
            self.run = None
        return out, text[stop:]

    def _whole(self, piece: str) -> bytes:
        known = self.codec.known
        if len(known) >= REMEMBERED:
            known.clear()
        out = self.inner.push(piece.encode("utf-8", "surrogatepass")) + self.inner.end()
        if len(piece) <= LONG:
            known[piece] = out
        return out


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token that suffice to fix it.

    Let two texts agree up to some byte, and follow both through the merge list. Where their tokens first differ moves to the
    left only by a merge (a, b) that one text has and the other hasn't, with b starting at that place: by len(a). The next
    such merge comes later in the list, and its right part starts with a. So the place moves by the sum of the left parts
    along such a chain at most; the longest chain is found in one pass over the list.
    """
    best: dict[bytes, int] = {}
    longest = 0
    for a, b in merges:
        far = len(a) + max((best.get(b[:i], 0) for i in range(1, len(b) + 1)), default=0)
        best[a] = max(far, best.get(a, 0))
        longest = max(longest, far)
    return longest


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_digest(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """One row a document: doc_id, n_tokens, sha256 of its ids (little-endian 32 bits) and of the text they decode to, and, if asked for,
    the ids themselves.

    Null is an empty text: no tokens. Null and repeated ids are rows of their own; an empty table has an empty result. No shuffle;
    ids are digested and decoded run by run, so a text of any length needs constant memory besides itself (and its ids, if
    they are asked for). Other columns, whatever their names, are left behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in pieces(batches):
            n_tokens, ids_sha, text_sha, kept = [], [], [], []
            for text in texts_of(batch):
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0

                def through(text=text or ""):
                    nonlocal n
                    for tokens in bpe.encode(text):
                        n += len(tokens) // 4
                        ids.update(tokens)  # noqa: B023
                        if with_ids:
                            kept.append(tokens)  # noqa: B023
                        yield tokens

                for part in bpe.decode(through()):
                    back.update(part.encode("utf-8"))
                n_tokens.append(n)
                ids_sha.append(ids.hexdigest())
                text_sha.append(back.hexdigest())
            columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(kept), "<i4"))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_tokens))), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary_path())
