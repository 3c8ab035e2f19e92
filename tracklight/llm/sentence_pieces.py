"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protocol buffer; it is parsed here, without generated code. From it the
normaliser, the metaspace marker and the model are rebuilt: unigram scores with byte fallback for a
unigram model, merges in the order of the scores with byte fallback for a BPE model. Batches are
encoded multithreaded, and the ids are this backend's. Parity: every text fragment that a worker encodes for the first time is encoded by
the sentencepiece library too, and where the ids differ, the fragment counts as a mismatch; it is decoded by this backend too, and
where that doesn't give the fragment back, texts that hold it don't come back.

Where no piece of the vocabulary reaches over a border of words, a text's ids are those of its
fragments in turn, so each distinct fragment is encoded once by a worker that remembers it.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracklight.llm.common import held, long, map_columns, string

MODEL = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")
SPACE = "▁"
#: Kinds of pieces and of models, as the format numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Fragments kept with their ids in a worker, and the longest that are kept, in characters.
CACHE, CACHE_CHARS = 300_000, 64
#: Fragments that are encoded at once, lines of a text among them, and fragments of the texts that are looked up together.
BATCH, LINES, TOGETHER = 4096, 512, 100_000


def _fields(data: bytes):
    """(number, value) of a message's fields: int for varints, bytes for all else."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            byte = data[at]
            out |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class PieceModel:
    """What a model file says, and encoders and decoders made from it."""

    def __init__(self, path: str = MODEL):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        with open(path, "rb") as file:
            data = file.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        rules: dict = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0" * 4))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} isn't unigram or BPE")
        fallback = bool(trainer.get(35, 0)) or BYTE in self.kinds
        self.add_prefix, trim, escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        self.charsmap = rules.get(2, b"")
        unknown = self.kinds.index(UNKNOWN)
        #: What pieces say: those of the vocabulary, and for the unknown piece the surface that the model file names.
        self.spoken = [*self.pieces[:unknown], trainer.get(44, " \u2047 ".encode()).decode(), *self.pieces[unknown + 1 :]]
        ids = {p: i for i, p in enumerate(self.pieces)}
        normal = {p for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER_DEFINED)}
        if kind == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores)), unknown, fallback)
        else:
            merges = []
            for piece in sorted((p for p in normal if len(p) > 1), key=lambda p: -self.scores[ids[p]]):
                halves = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in normal and piece[i:] in normal]
                merges += sorted(halves, key=lambda h: (ids[h[0]], ids[h[1]]))
            model = models.BPE(ids, merges, cache_capacity=0, unk_token=self.pieces[unknown], fuse_unk=True, byte_fallback=fallback)
        self.tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(SPACE)] if self.add_prefix else []
        steps += [normalizers.Replace(" ", SPACE)] if escape else []
        self.normalizer = normalizers.Sequence(steps)
        self.plain = not self.charsmap and not trim and escape
        undo = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
        self.inner = decoders.Sequence(undo)  # of ids that aren't a text's first
        self.decoder = decoders.Sequence(undo + [decoders.Strip(" ", 1, 0)]) if self.add_prefix else self.inner
        for i in (i for i, k in enumerate(self.kinds) if k == CONTROL):
            self.decoder_skips = {*getattr(self, "decoder_skips", ()), i}
        over = re.compile(rf"[^{SPACE}]{SPACE}|\n")
        #: No piece reaches from a word into the next space or over a line's end: fragments stand alone.
        self.separable = not any(over.search(p) for p in normal)
        self.fragment = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if self.separable else r"(?s).+")

    def normalize(self, text: str) -> str:
        """The text as the model reads it."""
        if not text:
            return ""
        if self.plain:
            return (SPACE if self.add_prefix else "") + text.replace(" ", SPACE)
        out = self.normalizer.normalize_str(text)
        return "" if out == SPACE else out

    def encode_normalized(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids) -> str:
        """The text of ids; control pieces say nothing."""
        skips = getattr(self, "decoder_skips", ())
        return self.decoder.decode([self.spoken[i] for i in ids if i not in skips])


class Encoder:
    """A model with the fragments that this process has encoded."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        self.model = PieceModel(path)
        self.known: dict[str, bytes] = {}
        self.other: set[str] = set()  # fragments on which the libraries differ
        self.lossy: set[str] = set()  # fragments that decoding doesn't give back
        # the same model with add_dummy_prefix and remove_extra_whitespaces off, so that a fragment is read as it is:
        # of a field that is given twice, protocol buffers take the last
        with open(path, "rb") as file:
            data = file.read() + b"\x1a\x04\x18\x00\x20\x00"
        self.checker = sentencepiece.SentencePieceProcessor(model_proto=data)
        end = self.checker.encode("\n")
        self.line_end = end[0] if self.model.separable and len(end) == 1 else None

    def lost(self, text: str, ids) -> bool:
        """Whether decoding doesn't give a normalised text back."""
        pieces = self.model.spoken
        return self.model.inner.decode([pieces[i] for i in ids]) != text.replace(SPACE, " ")

    def ids_of(self, fragments: list[str]) -> tuple[list[bytes], list[bytes], list[bool]]:
        """Ids of fragments by either library, as little-endian int32, and whether decoding loses something.

        Where lines' ends stand alone, fragments are encoded as the lines of a few long texts, several at once by
        the threads of the library, and cut at the line ends' ids; texts that decode whole have lost no line.
        """
        if self.line_end is not None and "\n" not in fragments:
            texts = ["\n".join(fragments[i : i + LINES]) for i in range(0, len(fragments), LINES)]
            found, lossy = [], []
            for rows in (self.model.encode_normalized(texts), self.checker.encode(texts, num_threads=1)):
                cut = []
                for text, ids in zip(texts, rows):
                    if not found:
                        lossy += [self.lost(text, ids)] * (text.count("\n") + 1)
                    ids = np.array(ids, "<i4")
                    ends = 4 * np.flatnonzero(ids == self.line_end)
                    packed = ids.tobytes()
                    cut += [packed[i:j] for i, j in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(packed)])]
                found.append(cut)
            if len(found[0]) == len(found[1]) == len(fragments):
                pairs = zip(fragments, found[0], lossy)
                return *found, [bad and self.lost(x, np.frombuffer(ids, "<i4").tolist()) for x, ids, bad in pairs]
        ours, theirs = self.model.encode_normalized(fragments), self.checker.encode(fragments, num_threads=1)
        lossy = [self.lost(x, ids) for x, ids in zip(fragments, ours)]
        return [np.array(x, "<i4").tobytes() for x in ours], [np.array(x, "<i4").tobytes() for x in theirs], lossy

    def learn(self, fragments: list[str]) -> dict[str, bytes]:
        """Ids of new fragments, as little-endian int32; those of moderate length are kept."""
        out = {}
        for start in range(0, len(fragments), BATCH):
            part = fragments[start : start + BATCH]
            ours, theirs, lossy = self.ids_of(part)
            out.update(zip(part, ours, strict=True))
            if ours != theirs:
                self.other.update(x for x, a, b in zip(part, ours, theirs) if a != b)
            if any(lossy):
                self.lossy.update(x for x, bad in zip(part, lossy) if bad)
        if len(self.known) + len(out) > CACHE:
            self.known.clear()
            self.other &= out.keys()
            self.lossy &= out.keys()
        self.known.update((k, v) for k, v in out.items() if len(k) <= CACHE_CHARS)
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[int], list[bool]]:
        """For each text its ids, as little-endian int32, how many fragments the libraries differ on, and whether it comes back."""
        ids, differ, same = [], [], []
        at = 0
        while at < len(texts):
            rows, n = [], 0
            while at < len(texts) and n < TOGETHER:
                text = texts[at]
                rows.append((text or "", self.model.fragment.findall(self.model.normalize(text)) if text else []))
                n += len(rows[-1][1])
                at += 1
            kinds = set().union(*(x for _, x in rows))
            new = [x for x in kinds if x not in self.known]
            if len(self.known) + len(new) > CACHE:  # all is forgotten: what these texts need is learned together
                new = list(kinds)
            more = self.learn(new)
            known = self.known
            for text, fragments in rows:
                try:
                    packed = b"".join(map(known.__getitem__, fragments))
                except KeyError:  # some are too long to be kept
                    packed = b"".join([more[x] if x in more else known[x] for x in fragments])
                ids.append(packed)
                differ.append(sum(x in self.other for x in fragments) if self.other else 0)
                if self.model.plain:  # each fragment was decoded when it was learned, and no character reaches over a border of fragments
                    same.append(SPACE not in text and not (self.lossy and any(x in self.lossy for x in fragments)))
                else:
                    same.append(self.model.decode(np.frombuffer(packed, "<i4").tolist()) == text)
        return ids, differ, same


def load(path: str) -> Encoder:
    """The encoder of a model file, with the fragments seen by this process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", "2")  # a worker stands beside others of its executor
    return held(("sentence pieces", path), lambda: Encoder(path))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
DIGESTS = (long("n_tokens"), string("ids_sha256"), T.StructField("round_trip", T.BooleanType()), long("n_mismatches"))


def encode(df: DataFrame, text: str = "text", path: str = MODEL, ids: bool = True, drop_text: bool = False) -> DataFrame:
    """`df` with the whole text's pieces.

    ids (array of int, if asked for), n_tokens (long), ids_sha256 (hex digest of the ids as
    little-endian int32), round_trip (boolean: decoding gives the text as it was; false where the text
    holds the marker U+2581 itself; with a plain model each distinct fragment is decoded, with any other the whole text) and n_mismatches
    (long: fragments on which the tokenizers library, whose ids these are, and the sentencepiece library differ). Null and empty texts have no ids. Neither
    start nor end pieces are added, and strings of control pieces are ordinary text. Columns of `df` with these names
    are replaced, other columns and repeated rows stay.
    """

    def make():
        encoder = load(path)
        def run(column):
            texts = column.to_pylist()
            packed, differ, same = encoder.encode(texts)
            out = []
            if ids:
                values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), values, type=pa.list_(pa.field("element", pa.int32(), False))))
            digests = [hashlib.sha256(x).hexdigest() for x in packed]
            return [*out, [len(x) // 4 for x in packed], digests, same, differ]

        return run

    return map_columns(df, make, [text], [*([IDS] if ids else []), *DIGESTS], drop=[text] if drop_text else [])


def decode(df: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """`df` with decoded (string): the text of the ids. Null ids give null, no ids an empty text."""

    def make():
        model = load(path).model
        return lambda column: [[None if x is None else model.decode(x) for x in column.to_pylist()]]

    return map_columns(df, make, [ids], [string("decoded")])
