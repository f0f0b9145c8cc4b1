"""Operator 10: byte-level BPE encoding and decoding.

Encoding runs a finite-state transducer compiled from the merges.  A token
sequence is the BPE encoding of a text exactly if each two neighbours stay apart
when their own bytes are merged, so a nondeterministic transducer that walks a
trie of the tokens and checks each token against the one before it accepts just
the encoding.  It is determinised lazily, byte by byte: a state holds the token
boundaries still possible, each with the tokens not yet emitted; what all of them
share is emitted at once.  A boundary survives only while the bytes after it
spell the start of a token, so a token is emitted within a lookahead of the
longest token.  The end of a piece that leaves the known states is walked
without determinising, since rare words seldom meet again.  Decoding streams through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from chromaloom.llm.common import TwoGenerationCache, arrow_map, kept_by_worker, string_list
from chromaloom.llm.pretokens import piece_finder

CACHED_PIECES = 80_000
#: The determinised states are dropped and built anew beyond this number.
CACHED_STATES = 120_000
#: A piece whose next transition is not known is walked on without determinising, where so few bytes are left ...
LAST_BYTES = 3
#: ... or so few once it has added a state: a rare word leaves a state or two, not one a byte.
WALKED_BYTES = 64
#: Remembered answers whether two tokens may stand side by side.
CACHED_PAIRS = 150_000
#: Ids that a decoder takes at once.
IDS_AT_ONCE = 8192


def read_ranks(text: str) -> dict[bytes, int]:
    """Ranks by token of a rank file: a base64 token and its rank a line."""
    rows = (line.split() for line in text.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in rows}


class Transducer:
    """BPE of single pre-tokens by a lazily determinised finite-state transducer."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._older_fits: dict[tuple[int, int], bool] = {}
        self._spell()
        self._reset()

    def _spell(self) -> None:
        """The trie: children by ``node * 256 + byte``, and for each node its token or -1 and whether it goes on."""
        self.below: dict[int, int] = {}
        self.token: list[int] = [-1]
        for spelled, rank in self.ranks.items():
            node = 0
            for byte in spelled:
                at = node << 8 | byte
                node = self.below.get(at, -1)
                if node < 0:
                    node = self.below[at] = len(self.token)
                    self.token.append(-1)
            self.token[node] = rank
        self.goes_on = bytearray(len(self.token))
        for at in self.below:
            self.goes_on[at >> 8] = 1

    def _reset(self) -> None:
        # a state: boundaries (tokens not yet emitted, token before the walk, trie node)
        start = (((), -1, 0),)
        self.number = {start: 0}
        self.states = [start]
        #: by ``state * 256 + byte``: the next state and the tokens that are now certain
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token that merging never makes."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                best = min((self.ranks.get(x + y, token), k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] >= token:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def makeable(self, token: int) -> bool:
        """Whether merging the token's own bytes ends in this token."""
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when the bytes of both are merged.

        The merges that made them are undone from the last one on.  Whenever
        the tokens that then touch could have merged before what was undone
        last, the pair would not have survived.
        """
        ranks, spelled, a, b = self.ranks, self.bytes_of, left, right
        undone_left = undone_right = None  # ranks of the last merge undone on each side
        answer = True
        while answer:
            joint = ranks.get(spelled[a] + spelled[b])
            if joint is not None and (undone_left is None or joint < undone_left) and (undone_right is None or joint <= undone_right):
                # equal ranks merge from the left: the joint merge starts left of the right side's
                answer = False
                break
            inner_a, inner_b = self.halves(a), self.halves(b)
            if inner_a is None and inner_b is None:
                break
            # a merge of equal rank on the right was made after the one on the left, so it is undone first
            if inner_a is None or (inner_b is not None and b >= a):
                undone_right, b = b, inner_b[0]
            else:
                undone_left, a = a, inner_a[1]
        return answer

    def fits(self, before: int, token: int) -> bool:
        """Whether the encoding may have ``token`` after ``before`` (-1: at the start)."""
        if len(self._fits) >= CACHED_PAIRS // 2:
            self._older_fits, self._fits = self._fits, {}
        answer = self._older_fits.get((before, token))
        if answer is None:
            answer = self.makeable(token) and (before < 0 or self.apart(before, token))
        self._fits[before, token] = answer
        return answer

    def _reached(self, boundaries: Iterable[tuple], byte: int) -> list[tuple]:
        """The boundaries after ``byte``.  A text has one encoding, so one token at most ends here."""
        reached, below_of, goes_on, token_of, known, ended = [], self.below, self.goes_on, self.token, self._fits, None
        for held, before, node in boundaries:
            below = below_of.get(node << 8 | byte)
            if below is None:
                continue
            if goes_on[below]:
                reached.append((held, before, below))
            if ended is None and (token := token_of[below]) >= 0:
                fits = known.get((before, token))
                if fits if fits is not None else self.fits(before, token):
                    ended = ((*held, token), token, 0)
        if ended is not None:
            reached.append(ended)
        return reached

    def _rest(self, boundaries: Iterable[tuple], rest: bytes) -> tuple[int, ...]:
        """The tokens from ``boundaries`` to the end of a piece, without determinising on the way."""
        for byte in rest[:-1]:
            boundaries = self._reached(boundaries, byte)
        byte, below_of, token_of, known = rest[-1], self.below, self.token, self._fits
        for held, before, node in boundaries:
            below = below_of.get(node << 8 | byte)
            if below is not None and (token := token_of[below]) >= 0:
                fits = known.get((before, token))
                if fits if fits is not None else self.fits(before, token):
                    return (*held, token)
        return ()

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one transition: the state after ``byte`` and the tokens that are now certain."""
        reached = self._reached(self.states[state], byte)
        first, sure = reached[0][0], 0
        shortest = min(len(held) for held, _, _ in reached)
        while sure < shortest and all(held[sure] == first[sure] for held, _, _ in reached):
            sure += 1
        after = tuple(sorted((held[sure:], before, node) for held, before, node in reached))
        move = self.moves[state << 8 | byte] = (self._numbered(after), first[:sure])
        return move

    def _numbered(self, boundaries: tuple) -> int:
        """The number of the state with these boundaries, a new one where there is none."""
        if boundaries not in self.number:
            self.number[boundaries] = len(self.states)
            self.states.append(boundaries)
        return self.number[boundaries]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token; a piece that is a token as a whole stays whole, as the library does."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.states) > CACHED_STATES:
            self._reset()
        state, out, moves, grown = 0, [], self.moves, False
        for at, byte in enumerate(piece):
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(piece) - at <= (WALKED_BYTES if grown else LAST_BYTES):
                    out.extend(self._rest(self.states[state], piece[at:]))
                    return tuple(out)
                grown = True
                if len(self.states) > CACHED_STATES:  # a long piece makes states without end; only its own goes on
                    held = self.states[state]
                    self._reset()
                    state, moves = self._numbered(held), self.moves
                move = self._step(state, byte)
            state, sure = move
            if sure:
                out.extend(sure)
        for held, _, node in self.states[state]:
            if node == 0:
                out.extend(held)
                break
        return tuple(out)


class Utf8Machine:
    """Bytes to text piece by piece; its state is the unfinished character at the end of a piece.

    Bytes that never make a character come out as U+FFFD, one for each maximal
    part of a character, as the standard decoder's ``replace`` gives them.
    """

    #: Lead bytes with the range of their second byte; later bytes are 80 to BF.
    SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    def __init__(self) -> None:
        self.unfinished = b""

    @classmethod
    def open_tail(cls, data: bytes) -> int:
        """How many bytes at the end may still become a character."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            low, high = cls.SECOND.get(lead, (0x80, 0xBF))
            return back if back == 1 or low <= data[-back + 1] <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.unfinished + data
        cut = len(data) - self.open_tail(data)
        self.unfinished = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.unfinished = self.unfinished, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encodes and decodes texts, remembering the pre-tokens that it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pieces = piece_finder(pattern)
        self.bytes_of = self.transducer.bytes_of
        self.known = TwoGenerationCache(CACHED_PIECES)
        self.written = [str(k) for k in range(max(self.bytes_of) + 1)]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        parts = [self.pieces(text) for text in texts]
        encode = self.transducer.encode
        for piece in self.known.missing(chain.from_iterable(parts)):
            self.known.young[piece] = encode(piece.encode())
        ids_of = self.known.young.__getitem__
        for pieces in parts:
            yield list(chain.from_iterable(map(ids_of, pieces)))

    def decode_bytes(self, ids: Iterable[int]) -> Iterator[bytes]:
        """The bytes of the ids, a bounded part at a time."""
        ids = list(ids)
        for k in range(0, len(ids), IDS_AT_ONCE):
            yield b"".join(map(self.bytes_of.__getitem__, ids[k : k + IDS_AT_ONCE]))

    def decode(self, ids: Iterable[int]) -> str:
        machine = Utf8Machine()
        return "".join(map(machine.feed, self.decode_bytes(ids))) + machine.finish()


def codec_for(ranks_text: str, pattern: str) -> Codec:
    """The codec of this Python worker, kept from task to task."""
    return kept_by_worker("codec", (hash(ranks_text), pattern), lambda: Codec(read_ranks(ranks_text), pattern))


def _shared_ranks(df: DataFrame, ranks_path: str):
    """The rank file, of fixed size, as a broadcast."""
    with open(ranks_path, encoding="ascii") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, ids array<int>`` for every whole text; null and empty texts have no ids.  No shuffle."""
    shared = _shared_ranks(docs, ranks_path)
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value, pattern)
        for batch in batches:
            ids = list(codec.encode(string_list(batch, "text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    return arrow_map(rows, run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``id, text`` from ``ids``; a null list gives the empty text, an unknown id an error."""
    shared = _shared_ranks(encoded, ranks_path)
    rows = encoded.select(encoded[id_column].alias("id"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value, pattern)
        for batch in batches:
            texts = [codec.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_column, "text"])

    return arrow_map(rows, run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids again, and return digests of both.

    ``id, n_tokens, ids_sha256, decoded_sha256, same_text``: the SHA-256 of the
    decimal ids joined by one space and of the decoded bytes, and whether the
    streamed text equals the input.  Null and empty texts have no ids and the
    digests of nothing; very long texts and pieces are encoded whole; of equal
    ranks the left merges first; repeated rows are kept; a null id stays null; an
    empty table gives an empty one; other columns are not read.
    """
    shared = _shared_ranks(docs, ranks_path)
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared.value, pattern)
        written = codec.written
        for batch in batches:
            texts = string_list(batch, "text")
            counts, id_digests, byte_digests, same = [], [], [], []
            for text, ids in zip(texts, codec.encode(texts), strict=True):
                digest, machine, streamed = hashlib.sha256(), Utf8Machine(), []
                for part in codec.decode_bytes(ids):
                    digest.update(part)
                    streamed.append(machine.feed(part))
                streamed.append(machine.finish())
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(" ".join(map(written.__getitem__, ids)).encode()).hexdigest())
                byte_digests.append(digest.hexdigest())
                same.append("".join(streamed) == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(byte_digests, pa.string()), pa.array(same, pa.bool_())],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256", "same_text"],
            )

    return arrow_map(rows, run, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean")
