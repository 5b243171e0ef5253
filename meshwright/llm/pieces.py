"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text is normalised as the model says (here: spaces become U+2581 and one is put before the
text) and cut before each run of U+2581; no piece spans such a cut, so words are segmented
on their own. The distinct words of a batch are grouped by length and all words of a length
advance together: at every end position the substrings of each possible length are hashed,
looked up in the sorted hashes of the pieces, and a vectorised maximum keeps the best score
and a backpointer. A character that no piece covers becomes its bytes. Words are cut further
where no piece spans a letter and a sign, so most are plain runs of letters.

For a unigram model the best path has the highest sum of piece scores. A byte-pair model's
own ids are a best path too, once a step from piece A to piece B is allowed only if merging
never crosses their border: a piece can follow another iff no part on the right edge of A and
part on the left edge of B form a piece that ranks before both parts' next merges (on equal
ranks the left one goes first). Exactly one allowed path remains, and it is the library's.

Defined cases: a null or empty text has no ids and decodes to an empty text; equal texts get
equal ids; a word over ``LONG_WORD`` characters advances by itself; control, unknown and
byte pieces never match a substring; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshwright.llm.common import small_arrow_batches

SPACE = "▁"
LONG_WORD = 256
#: Segmented words kept between batches.
KNOWN_WORDS = 500_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BASE = np.uint64(0x100000001B3)


class PieceModel:
    """Pieces, scores and types of a SentencePiece file, and the tables of the Viterbi."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as src:
            proto.ParseFromString(src.read())
        self.pieces = [p.piece for p in proto.pieces]
        self.types = np.array([p.type for p in proto.pieces])
        self.scores = np.array([p.score for p in proto.pieces], np.float32)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.squeeze = proto.normalizer_spec.remove_extra_whitespaces
        self.unk = int(np.flatnonzero(self.types == UNKNOWN)[0])
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i in np.flatnonzero(self.types == BYTE):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        live = np.flatnonzero((self.types == NORMAL) | (self.types == USER))
        self.cuts = self._cut_rule(live)
        self.bpe = proto.trainer_spec.model_type == 2
        if self.bpe:
            live = self._merge_trees(live)
        lengths = np.array([len(self.pieces[i]) for i in live])
        self.longest = int(lengths.max())
        self.penalty = float(self.scores[live].min()) - 10.0
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(lengths).tolist():
            ids = live[lengths == n]
            codes = np.array([[ord(c) for c in self.pieces[i]] for i in ids], np.uint64)
            h = self._hash(codes)
            order = np.argsort(h)
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces of the model share a hash")
            self.tables[n] = (h[order], ids[order].astype(np.int32), codes[order].astype(np.uint32))
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE, np.uint64)]), dtype=np.uint64)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _cut_rule(self, live: np.ndarray) -> re.Pattern:
        """Borders of letters and signs that lie inside no piece: words may be cut there."""
        inside = {p[k : k + 2] for i in live.tolist() if len(p := self.pieces[i]) > 1 for k in range(len(p) - 1)}
        letters = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
        letter = re.compile(f"[{letters}]")
        ends = {x[1] for x in inside if letter.match(x[0])}  # signs that some piece has after a letter
        starts = {x[0] for x in inside if letter.match(x[1])}
        signs = [chr(c) for c in (10, *range(33, 127)) if not chr(c).isalnum()]
        after = "".join(re.escape(c) for c in signs if c not in ends)
        ahead = "".join(re.escape(c) for c in signs if c not in starts)
        alone = "".join(re.escape(c) for c in signs if not any(c in x for x in inside))
        rules = [f"(?<=[{letters}])(?=[{after}])" if after else "", f"(?<=[{ahead}])(?=[{letters}])" if ahead else "", f"(?<=[{alone}])|(?=[{alone}])" if alone else ""]
        return re.compile("|".join(r for r in rules if r) or "(?!)")

    def _merge_trees(self, live: np.ndarray) -> np.ndarray:
        """The edges of each piece's merge tree, and which live pieces merging can make."""
        rank = {self.pieces[i]: r for r, i in enumerate(sorted(live.tolist(), key=lambda i: (-self.scores[i], i)))}
        score = {self.pieces[i]: float(self.scores[i]) for i in live.tolist()}
        ids = {self.pieces[i]: i for i in live.tolist()}
        far = len(rank) + 1
        split: dict[str, tuple[str, str]] = {}
        reach = []
        for piece in rank:
            parts = list(piece)
            pair = None
            while len(parts) > 1:
                options = [(-score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
                if not options:
                    break
                k = min(options)[1]
                pair = (parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1:
                reach.append(ids[piece])
                if pair:
                    split[piece] = pair
        def chain(piece: str, take: int) -> int:
            """How many pieces the edge of a merge tree has, down to a single character."""
            steps = 1
            while piece in split:
                piece, steps = split[piece][take], steps + 1
            return steps

        depth = max((chain(self.pieces[i], take) for i in reach for take in (0, 1)), default=1)
        n = len(self.pieces)
        self.edge = {side: (np.full((n, depth), -1, np.int32), np.full((n, depth), far, np.int32)) for side in ("left", "right")}
        for i in reach:
            for side, take in (("left", 0), ("right", 1)):
                part, death = self.pieces[i], far
                for d in range(depth):
                    self.edge[side][0][i, d] = ids.get(part, -1)
                    self.edge[side][1][i, d] = death
                    if part not in split:
                        break
                    death, part = rank[part], split[part][take]
        keys = {}
        for piece, r in rank.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    keys[a * n + b] = r
        order = sorted(keys)
        self.pair_keys = np.array(order, np.int64)
        self.pair_rank = np.array([keys[k] for k in order], np.int32)
        self.seen_key = np.full(1 << 20, -1, np.int64)
        self.seen_ok = np.zeros(1 << 20, bool)
        return np.array(sorted(reach))

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between pieces a and b alone."""
        key = a.astype(np.int64) * len(self.pieces) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        fresh = self.seen_key[slot] != key
        if fresh.any():
            todo = np.unique(key[fresh])
            x, y = todo // len(self.pieces), todo % len(self.pieces)
            ok = np.ones(len(todo), bool)
            for i in range(self.edge["right"][0].shape[1]):
                p, dp = self.edge["right"][0][x, i], self.edge["right"][1][x, i]
                if (p < 0).all():
                    break
                for j in range(self.edge["left"][0].shape[1]):
                    q, dq = self.edge["left"][0][y, j], self.edge["left"][1][y, j]
                    if (q < 0).all():
                        break
                    want = p.astype(np.int64) * len(self.pieces) + q
                    at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
                    r = self.pair_rank[at]
                    ok &= ~((p >= 0) & (q >= 0) & (self.pair_keys[at] == want) & (r < dp) & (r <= dq))
            place = np.searchsorted(todo, key)
            answer = np.where(todo[np.minimum(place, len(todo) - 1)] == key, ok[np.minimum(place, len(todo) - 1)], self.seen_ok[slot])
            self.seen_key[slot[fresh]], self.seen_ok[slot[fresh]] = key[fresh], answer[fresh]
            return answer
        return self.seen_ok[slot]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(codes.shape[:-1], np.uint64)
        for i in range(codes.shape[-1]):
            h = h * BASE + codes[..., i] + np.uint64(1)
        return h

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(text.split(" ")).strip(" ")
            while "  " in text:
                text = text.replace("  ", " ")
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    @staticmethod
    def words(text: str) -> list[str]:
        """Cut before each run of the space mark."""
        if not text:
            return []
        parts = text.split(SPACE)
        out, run = ([parts[0]] if parts[0] else []), 0
        for p in parts[1:]:
            run += 1
            if p:
                out.append(SPACE * run + p)
                run = 0
        if run:
            out.append(SPACE * run)
        return out

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words that all have the same number of characters."""
        n, k = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(k, n)
        # running hashes: the hash of a substring is a difference of two of them
        wide = codes.astype(np.uint64) + np.uint64(1)
        run = np.zeros((k, n + 1), np.uint64)
        for i in range(n):
            run[:, i + 1] = run[:, i] * BASE + wide[:, i]
        best = np.full((k, n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((k, n + 1), np.int32)  # length of the last piece
        last = np.zeros((k, n + 1), np.int32)  # its id, -1 for an uncovered character
        for end in range(1, n + 1):
            for size in range(min(end, self.longest), 0, -1):
                if size not in self.tables:
                    continue
                keys, ids, exact = self.tables[size]
                h = run[:, end] - run[:, end - size] * self.power[size]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                if not hit.any():
                    continue
                row = np.flatnonzero(hit)
                at = at[row]
                same = (exact[at] == codes[row, end - size : end]).all(1)
                row, at = row[same], at[same]
                if self.bpe and end > size:
                    ahead = last[row, end - size]
                    ok = ahead < 0
                    ok[~ok] = self._may_follow(ahead[~ok], ids[at[~ok]])
                    row, at = row[ok], at[ok]
                total = best[row, end - size] + self.scores[ids[at]]
                better = total > best[row, end]
                row, at = row[better], at[better]
                best[row, end], back[row, end], last[row, end] = total[better], size, ids[at]
            total = best[:, end - 1] + np.float32(self.penalty)
            bare = (best[:, end] == -np.inf) if self.bpe else total > best[:, end]
            best[bare, end], back[bare, end], last[bare, end] = total[bare], 1, -1
        # walk back through all words at once, filling ids from the right
        ids, fill, at = np.empty((k, n), "<i4"), np.full(k, n), np.full(k, n)
        bare = np.zeros(k, bool)
        live = np.arange(k)
        while len(live):
            here = at[live]
            got = last[live, here]
            fill[live] -= 1
            ids[live, fill[live]] = got
            bare[live[got < 0]] = True
            at[live] = here - back[live, here]
            live = live[at[live] > 0]
        out = [row[f:].tobytes() for row, f in zip(ids, fill.tolist(), strict=True)]
        for j in np.flatnonzero(bare).tolist():
            place, grown = 0, []
            for i in ids[j, fill[j] :].tolist():
                if i >= 0:
                    grown.append(i)
                    place += len(self.pieces[i])
                else:
                    grown += self.byte_ids[list(words[j][place].encode("utf-8", "surrogatepass"))].tolist()
                    place += 1
            out[j] = np.array(grown, "<i4").tobytes()
        return out

    def learn(self, words: set[str]) -> None:
        known, done = self.known, self.parts
        cut, mark = self.cuts.split, "" if not self.prefix else SPACE
        compound = {w: list(filter(None, cut(w if SPACE in w else mark + w))) for w in words.difference(known)}
        by_length: dict[int, list[str]] = {}
        for p in set().union(*compound.values()).difference(done):
            by_length.setdefault(len(p), []).append(p)
        for n, group in by_length.items():
            step = max(1, 4_000_000 // max(n, 1)) if n <= LONG_WORD else 1
            for at in range(0, len(group), step):
                part = group[at : at + step]
                done.update(zip(part, self._viterbi(part), strict=True))
        known.update({w: done[parts[0]] if len(parts) == 1 else b"".join([done[p] for p in parts]) for w, parts in compound.items()})

    def _keys(self, text: str | None) -> list[str]:
        """The words of a text; one without the space mark stands for itself after one."""
        if not text:
            return []
        if self.prefix and not self.squeeze and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return self.words(self.normalize(text))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        single = dict.fromkeys(texts)  # copies in a batch are encoded once
        rows = {t: self._keys(t) for t in single}
        if len(self.known) > KNOWN_WORDS:
            self.known, self.parts = {}, {}
        self.learn(set().union(*rows.values()) if rows else set())
        look = self.known.__getitem__
        for t, row in rows.items():
            single[t] = np.frombuffer(b"".join(map(look, row)), "<i4")
        return [single[t] for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        out = bytearray()
        table = self._bytes_of()
        for i in ids.tolist():
            out += table[i]
        text = out.decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _bytes_of(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            self._table = [
                bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.encode()
                for p, t in zip(self.pieces, self.types.tolist(), strict=True)
            ]
        return self._table


def encode_table(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_byte_ids, round_trip, ids of every row of docs.

    ``round_trip`` says whether decoding the ids gives the text (with a literal U+2581 read
    back as the space it stands for).
    """
    spark = docs.sparkSession
    small_arrow_batches(spark, 500)
    shared = spark.sparkContext.broadcast(PieceModel(model_path))
    schema = "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = model.encode(texts)
            low, high = model.byte_ids.min(), model.byte_ids.max()
            same = [model.decode(i) == (t or "").replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
            size = np.array([len(i) for i in ids], np.int64)
            flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(size),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    pa.array([int(((i >= low) & (i <= high)).sum()) for i in ids], pa.int64()),
                    pa.array(same, pa.bool_()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())),
                ],
                names=["doc_id", "n_ids", "ids_crc32", "n_byte_ids", "round_trip", "ids"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, schema)
