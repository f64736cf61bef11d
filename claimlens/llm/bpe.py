"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if every adjacent pair is: joined
and merged by rank, the two tokens come out again. So the encoding of each prefix ends in the one token
that is compatible with the end of the prefix before it. The transducer reads a byte at a time. Its state
holds the last tokens of those recent prefixes at which a later token may still begin; a token is emitted
as soon as all of them agree on it, which takes at most the longest token's bytes of lookahead. States and
transitions are made when first met and dropped together when there are too many.

Decoding. Token bytes are joined block by block; a state machine over UTF-8 lead and continuation bytes
holds back the bytes of an unfinished character (three at most) until the next block.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import threading
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.texts import trimmed


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


NEVER = 1 << 62
SHORT = 48
MARKS = ".,!?;:%*&$#"
LATIN_END = "\u0250"
_ONE = [bytes([b]) for b in range(256)]


class State:
    """What the text read so far still allows.

    ``pending`` are the bytes since the last emitted token; ``last`` has for each prefix of them the last
    token of its encoding, where it can still matter; ``live`` the places where a token may yet begin.
    """

    __slots__ = ("last", "live", "next", "pending", "rest")

    def __init__(self, pending: bytes, last: tuple[int | None, ...], live: tuple[int, ...]):
        self.pending, self.last, self.live = pending, last, live
        self.next: dict[int, tuple[State, bytes] | bool] = {}
        self.rest: bytes | None = None


class Transducer:
    """From bytes to packed little-endian 32-bit token ids."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 60_000):
        self.ranks, self.most_states = ranks, most_states
        self.size = {i: len(t) for t, i in ranks.items()}
        self.token = {i: t for t, i in ranks.items()}
        # for each beginning of a token: twice its id (-1 if it is none), plus one if longer tokens begin with it
        self.known = dict.fromkeys((t[:k] for t in ranks for k in range(1, len(t))), -1)
        for t, i in ranks.items():
            self.known[t] = 2 * i + (t in self.known)
        self.packed = {i: i.to_bytes(4, "little") for i in ranks.values()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, bytes]] | None] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states; results do not depend on when."""
        self.start = State(b"", (-1,), (0,))
        self.states = {(b"", (-1,)): self.start}

    def merged(self, data: bytes, watch: list | None = None, end: int = 0) -> list[bytes]:
        """Merge adjacent parts by lowest rank, the leftmost first; for the few bytes of a token or two.

        ``watch`` gets (rank, part at ``end`` before the merge) for each merge that changes the part there.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            before = parts[end]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if watch is not None and parts[end] != before:
                watch.append((rank, before))
        return parts

    def edge(self, token: int, end: int) -> list[tuple[int, bytes]] | None:
        """The parts that stand in turn at one end of a token while it is merged, each until a rank.

        None if the token does not merge to itself, or not by rising ranks.
        """
        key = (token, end)
        if key not in self.edges:
            whole, steps = self.token[token], []
            alone = self.merged(whole, steps, end) == [whole]
            rising = all(a[0] < b[0] for a, b in zip(steps, steps[1:], strict=False))
            self.edges[key] = [*steps, (NEVER, whole)] if alone and rising else None
        return self.edges[key]

    def compatible(self, before: int, token: int) -> bool:
        """Whether the two tokens stay apart when merged; -1 before the first token."""
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) > 4 * self.most_states:
                self.pairs.clear()
            known = self.pairs[before, token] = self._stay_apart(before, token)
        return known

    def _stay_apart(self, before: int, token: int) -> bool:
        """Walk the parts at the common border in the order of time; they must never form a token first."""
        right = self.edge(token, 0)
        left = self.edge(before, -1) if before >= 0 else []
        if right is None or left is None:
            pair = [self.token[i] for i in (before, token) if i >= 0]
            return self.merged(b"".join(pair)) == pair
        i = j = 0
        since = -1
        while i < len(left):
            (gone_left, a), (gone_right, b) = left[i], right[j]
            rank = self.ranks.get(a + b, NEVER)
            if rank != NEVER:
                if rank <= since:  # a token made of later ones: decide by merging
                    return self.merged(self.token[before] + self.token[token]) == [self.token[before], self.token[token]]
                if rank < gone_left and rank <= gone_right:
                    return False
            if gone_left == gone_right == NEVER:
                return True
            if gone_left <= gone_right:
                since, i = gone_left, i + 1
            else:
                since, j = gone_right, j + 1
        return True

    def ids(self, last: tuple[int | None, ...], end: int) -> bytes:
        """Packed tokens of the prefix that ends at ``end``, since the last emitted one."""
        out = b""
        while end > 0:
            token = last[end]
            out = self.packed[token] + out
            end -= self.size[token]
        return out

    def read(self, pending: bytes, last: list[int | None], live: Sequence[int]) -> tuple[bytes, list[int | None], list[int]]:
        """Follow all live places over the bytes of ``pending`` that ``last`` does not know yet."""
        known, pairs = self.known, self.pairs
        for end in range(len(last), len(pending) + 1):
            newest, still = None, []
            for at in live:
                found = known.get(pending[at:end])
                if found is None:
                    continue
                if newest is None and found >= 0:
                    token, before = found >> 1, last[at]
                    apart = pairs.get((before, token))
                    if apart or (apart is None and self.compatible(before, token)):
                        newest = token
                if found & 1:
                    still.append(at)
            if newest is None:
                raise ValueError(f"no token for the bytes {pending[:end]!r}")
            last.append(newest)
            still.append(end)
            live = still
        return pending, last, live

    def step(self, state: State, byte: int) -> tuple[State, bytes]:
        """Make the transition from a state by a byte."""
        if len(self.states) > self.most_states:
            self.forget()
        pending, last, live = self.read(state.pending + _ONE[byte], list(state.last), state.live)
        end = len(pending)
        places, needed = list(live), set()
        while len(places) > 1:  # back from the furthest place until all ways meet
            at = places.pop()
            needed.add(at)
            before = at - self.size[last[at]]
            if before not in places:
                places.append(before)
                places.sort()
        common = places[0]
        if common in live:  # else no token can begin there, and what stands before it no longer matters
            needed.add(common)
        last, out = tuple([last[at] if at in needed else None for at in range(common, end + 1)]), self.ids(last, common)
        key = (pending[common:], last)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = State(*key, tuple([at - common for at in live]))
        state.next[byte] = found = (target, out)
        return found

    def encode(self, piece: bytes) -> bytes:
        """Packed ids of a piece.

        A transition is made when it is wanted for the second time. The first time, the rest of a short
        piece is read along without making states.
        """
        state, out = self.start, []
        for place, byte in enumerate(piece):
            found = state.next.get(byte)
            if not found:
                if found is None and len(piece) - place <= SHORT:
                    state.next[byte] = False
                    pending, last, _ = self.read(state.pending + piece[place:], list(state.last), state.live)
                    out.append(self.ids(last, len(pending)))
                    return b"".join(out)
                found = self.step(state, byte)
            state, emitted = found
            if emitted:
                out.append(emitted)
        if state.rest is None:
            state.rest = self.ids(state.last, len(state.pending))
        out.append(state.rest)
        return b"".join(out)


def public_pattern() -> str | None:
    """The pattern of the public tokenizers, where they are installed."""
    try:
        import public_tokenizers
    except ModuleNotFoundError as missing:
        if missing.name != "public_tokenizers":
            raise
        return None
    return public_tokenizers.PATTERN


class Remembered(dict):
    """Results by key. When full, all but those of the last generation are dropped; results never change."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def compute(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.compute(key)
            if len(key) > 64:
                return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids


class Pieces(Remembered):
    """Matches of the pattern and their packed ids."""

    def __init__(self, transducer: Transducer, most: int):
        super().__init__(most)
        self.transducer = transducer

    def compute(self, piece: str) -> bytes:
        return self.transducer.encode(piece.encode())


class Encoder(Remembered):
    """Texts to packed ids. With the public pattern, words with the blank before them are remembered.

    That pattern always parts a text before a blank that a character other than white space follows, so what
    stands between two such blanks is matched, and remembered, on its own. With any other pattern, whole texts
    are matched and only the matches are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 250_000):
        super().__init__(most)
        # as many as words: the same letters come again with other marks behind them
        self.pieces = Pieces(Transducer(ranks), most)
        self.matches = regex.compile(pattern).findall
        self.odd = regex.compile(r" (?:\s|$)").search
        # what the shortcut knows of words holds for this one pattern; others are asked about every word
        self.known = pattern == public_pattern()
        self.regular = self.known

    def compute(self, word: str) -> bytes:
        letters = word.rstrip(MARKS)
        if self.regular and letters.isalpha() and max(letters) < LATIN_END:
            # letters, and marks after them: what the pattern would find, without asking it
            marks = word[len(letters) :]
            return self.pieces[" " + letters] + (self.pieces[marks] if marks else b"")
        return self.plain(" " + word)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.matches(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known:
            return self.plain(text)
        words = text.split(" ")
        if self.odd(text):
            joined = words[:1]
            for w in words[1:]:
                if w and not w[0].isspace() and self.odd(" " + w[0]) is None:
                    joined.append(w)
                else:
                    joined[-1] += " " + w
            words = joined
        return self.plain(words[0]) + b"".join(map(self.__getitem__, words[1:]))


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get the characters finished so far; faulty bytes become U+FFFD."""

    def __init__(self):
        self.pending = b""

    @staticmethod
    def length(lead: int) -> int:
        """Bytes of the character that begins with this byte; 0 for bytes that begin none."""
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0

    def unfinished(self, data: bytes) -> int:
        """Number of bytes at the end that begin a character without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                return back if self.length(lead) > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        keep = self.unfinished(data)
        self.pending = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def decode_text(ids: np.ndarray, tokens: list[bytes], block: int = 1 << 16) -> str:
    """The text of token ids, decoded in blocks of ids that may end inside a character."""
    machine = Utf8Machine()
    out = [machine.feed(b"".join(map(tokens.__getitem__, ids[a : a + block].tolist()))) for a in range(0, len(ids), block)]
    out.append(machine.finish())
    return "".join(out)


_made: dict[tuple[str, str], Encoder] = {}
_rest: list[threading.Timer] = []
#: A worker that has had no task for so many seconds gives its states and remembered words back.
IDLE_SECONDS = 1.5


def _name(ranks: dict[bytes, int]) -> str:
    """A digest of the vocabulary."""
    return hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()


def _encoder(ranks: dict[bytes, int], pattern: str, name: str | None = None) -> Encoder:
    """The encoder of this worker process; it keeps its states from one task to the next.

    ``name``: the vocabulary's digest, which takes a third of a second to find; tasks get it from the driver.
    """
    while _rest:
        _rest.pop().cancel()
    key = (name or _name(ranks), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(ranks, pattern)
    return _made[key]


def _forget() -> None:
    _made.clear()
    gc.collect()
    trimmed()


def _task_over() -> None:
    """Idle workers are small: other operators' tasks share the executor's memory with them."""
    timer = threading.Timer(IDLE_SECONDS, _forget)
    timer.daemon = True
    _rest.append(timer)
    timer.start()


def _mapped(docs: DataFrame, ranks: dict[bytes, int], pattern: str, decode: bool) -> DataFrame:
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks lack single bytes")
    shared, name = docs.sparkSession.sparkContext.broadcast(ranks), _name(ranks)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern, name)
        tokens = [b""] * (max(shared.value.values()) + 1)
        for token, i in shared.value.items():
            tokens[i] = token
        gc.disable()  # states form no cycles that are dropped, and searching them for some is slow
        try:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for a in range(0, len(batch), 256):
                    part = [encoder.encode(t.as_py()) for t in texts.slice(a, 256)]
                    columns = [ids.slice(a, 256), pa.array(part, pa.binary())]
                    if decode:
                        columns.append(pa.array([decode_text(np.frombuffer(x, "<u4"), tokens) for x in part], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])
        finally:
            gc.enable()
            _task_over()

    schema = "doc_id long, ids binary" + (", text string" if decode else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids) of every row: ``ids`` are packed little-endian unsigned 32-bit token ids.

    Whole texts, no special tokens. Null and empty texts have no ids. Every row gives a row, repeated ones
    too; other columns are not read. ``ranks`` must hold all 256 single bytes, and is broadcast (its size is
    that of the vocabulary).
    """
    return _mapped(docs, ranks, pattern, decode=False)


def decoded(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, text) of every row of (doc_id, ids); null ids give an empty text, an unknown id fails."""
    vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        vocabulary[i] = token
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_text(np.frombuffer(x.as_py() or b"", "<u4"), shared.value) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(rows, "doc_id long, ids binary, text string")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Encode every document and decode its ids, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _mapped(docs, ranks, pattern, decode=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def public_vocabulary(spark: SparkSession) -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the public tokenizer that the registered queries use."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN
