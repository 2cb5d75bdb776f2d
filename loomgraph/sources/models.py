"""Static embedding models: matrices in safetensors files, WordPiece vocabularies, encoders.

A model is read on the driver and sent to the tasks, so its size is looked at first (MODEL_BYTES).
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_BYTES, HEADER_BYTES = 512 << 20, 64 << 20
MOST_TOKENS, MOST_CHARS = 4096, 100
_KINDS = {"F32": ("<f4", 4), "I8": ("i1", 1), "U8": ("u1", 1)}


def read_tensor(path: str, name: str):
    """One tensor of a safetensors file (F32, I8 or U8; one or two dimensions)."""
    import numpy as np

    with open(path, "rb") as f:
        (size,) = struct.unpack("<Q", f.read(8))
        if size > HEADER_BYTES:
            raise ValueError(f"a header of {size} bytes is no safetensors header")
        header = json.loads(f.read(size))
        if name not in header:
            raise ValueError(f"no tensor {name} in {path}")
        entry = header[name]
        kind, width = _KINDS.get(entry["dtype"], (None, 0))
        shape, (start, end) = entry["shape"], entry["data_offsets"]
        if kind is None or not 1 <= len(shape) <= 2 or end - start != width * int(np.prod(shape)) or end - start > MODEL_BYTES:
            raise ValueError(f"tensor {name}: {entry['dtype']} {shape} in {end - start} bytes isn't supported")
        f.seek(8 + size + start)
        data = f.read(end - start)
        if len(data) < end - start:
            raise ValueError(f"{path} is cut off")
        return np.frombuffer(data, dtype=kind).reshape(shape)


def write_tensors(path: str, tensors: dict) -> None:
    header, at, parts = {}, 0, []
    for name, x in tensors.items():
        kind = next(k for k, (t, _) in _KINDS.items() if x.dtype == t)
        data = x.tobytes()
        header[name] = {"dtype": kind, "shape": list(x.shape), "data_offsets": [at, at + len(data)]}
        at += len(data)
        parts.append(data)
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head + b"".join(parts))


def quantized(matrix):
    """(int8 matrix, scale of each row); the error of a weight is half a scale at most."""
    import numpy as np

    scale = np.abs(matrix).max(axis=1) / 127
    safe = np.where(scale == 0, 1, scale)
    return np.clip(np.floor(matrix / safe[:, None] + 0.5), -127, 127).astype(np.int8), scale.astype("<f4")


def quantization_report(matrix) -> dict:
    """Size ratio, worst error of a weight in scales, and worst drift of a row's cosine."""
    import numpy as np

    q, scale = quantized(matrix)
    back = q * scale[:, None].astype(np.float64)
    safe = np.where(scale == 0, 1, scale)[:, None]
    norms = np.linalg.norm(matrix, axis=1) * np.linalg.norm(back, axis=1)
    cos = np.where(norms == 0, 1, (matrix * back).sum(axis=1) / np.where(norms == 0, 1, norms))
    return {"ratio": (q.nbytes + scale.nbytes) / matrix.astype("<f4").nbytes, "worst_weight": float((np.abs(matrix - back) / safe).max()), "worst_drift": float((1 - cos).max())}


class WordPiece:
    """Lower case, accents off, punctuation apart, then the longest known pieces; a word that can't be pieced
    together, or is over MOST_CHARS long, is [UNK]."""

    def __init__(self, tokens: list[str]):
        self.ids: dict[str, int] = {}
        for i, t in enumerate(tokens):
            self.ids.setdefault(t, i)
        missing = [t for t in ("[CLS]", "[SEP]", "[UNK]") if t not in self.ids]
        if missing:
            raise ValueError(f"the vocabulary has no {', '.join(missing)}")

    @classmethod
    def from_file(cls, path: str) -> WordPiece:
        with open(path, encoding="utf-8") as f:
            return cls([line.rstrip("\r\n") for line in f])

    @staticmethod
    def words(text: str) -> list[str]:
        found, word = [], []
        for c in unicodedata.normalize("NFD", text.lower()):
            kind = unicodedata.category(c)
            if kind == "Mn":
                continue
            mark = kind.startswith("P") or 33 <= ord(c) <= 126 and not c.isalnum()
            if c.isspace() or kind == "Cc" or mark:
                if word:
                    found.append("".join(word))
                    word = []
                if mark:
                    found.append(c)
            else:
                word.append(c)
        return found + (["".join(word)] if word else [])

    def pieces(self, word: str) -> list[int]:
        unknown = [self.ids["[UNK]"]]
        if len(word) > MOST_CHARS:
            return unknown
        out, start = [], 0
        while start < len(word):
            for end in range(len(word), start, -1):
                if (i := self.ids.get(("##" if start else "") + word[start:end])) is not None:
                    break
            else:
                return unknown
            out.append(i)
            start = end
        return out

    def encode(self, text: str, most: int) -> list[int]:
        if most < 2:
            raise ValueError("there must be room for [CLS] and [SEP]")
        ids = [i for w in self.words(text) for i in self.pieces(w)]
        return [self.ids["[CLS]"], *ids[: most - 2], self.ids["[SEP]"]]

    def content(self, text: str, most: int = MOST_TOKENS) -> list[int]:
        unknown = self.ids["[UNK]"]
        return [i for w in self.words(text) for i in self.pieces(w) if i != unknown][:most]


@dataclass
class StaticEncoder:
    """The mean of a text's token vectors, at length 1; zeros if it knows none of the tokens."""

    tokenizer: WordPiece
    matrix: object
    scales: object = None

    @classmethod
    def from_folder(cls, folder: str) -> StaticEncoder:
        model = os.path.join(folder, "model.safetensors")
        if not os.path.exists(model):
            raise FileNotFoundError(f"no model.safetensors in {folder}")
        matrix = read_tensor(model, "embeddings")
        scales = read_tensor(model, "scales") if matrix.dtype == "i1" else None
        return cls(WordPiece.from_file(os.path.join(folder, "vocab.txt")), matrix, scales)

    def vector(self, text: str):
        import numpy as np

        ids = self.tokenizer.content(text or "")
        if not ids:
            return np.zeros(self.matrix.shape[1], dtype=np.float32)
        rows = self.matrix[ids].astype(np.float64)
        if self.scales is not None:
            rows = rows * self.scales[ids][:, None]
        mean = rows.mean(axis=0)
        n = np.linalg.norm(mean)
        return (mean / n if n else mean).astype(np.float32)


class EncoderUnavailable(RuntimeError):
    """There is no encoder, or what it needs isn't there."""


@dataclass
class OnnxEncoder:
    """The masked mean of a transformer's last layer, at length 1, of at most MOST_TOKENS tokens. It is told by its
    folder, so that each task opens the model for itself."""

    folder: str

    def __post_init__(self):
        self._session = None

    def __getstate__(self):
        return {"folder": self.folder}

    def __setstate__(self, state):
        self.folder, self._session = state["folder"], None

    def open(self):
        if self._session is None:
            try:
                import onnxruntime
            except ImportError as e:
                raise EncoderUnavailable("model.onnx needs onnxruntime; a static model.safetensors doesn't") from e
            self._session = onnxruntime.InferenceSession(os.path.join(self.folder, "model.onnx"), providers=["CPUExecutionProvider"])
            self._words = WordPiece.from_file(os.path.join(self.folder, "vocab.txt"))
        return self._session

    def vector(self, text: str):
        import numpy as np

        session = self.open()
        ids = np.array([self._words.encode(text or "", MOST_TOKENS)], dtype=np.int64)
        every = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
        states = session.run(None, {i.name: every[i.name] for i in session.get_inputs()})[0][0]
        mean = states.astype(np.float64).mean(axis=0)
        n = np.linalg.norm(mean)
        return (mean / n if n else mean).astype(np.float32)


def open_encoder(folder: str | None):
    """The encoder of a model folder: a static one before one that needs a runtime. Raises EncoderUnavailable."""
    if not folder:
        raise EncoderUnavailable("no model folder is given")
    if os.path.isfile(os.path.join(folder, "model.safetensors")):
        return StaticEncoder.from_folder(folder)
    if not os.path.isfile(os.path.join(folder, "model.onnx")):
        raise EncoderUnavailable(f"neither model.safetensors nor model.onnx is in {folder}")
    encoder = OnnxEncoder(folder)
    encoder.open()
    return encoder


def resolve_encoder(configured: str | None, packaged: str | None = None):
    """The encoder that is configured, else the one that is shipped, else none."""
    if configured:
        return open_encoder(configured)
    return StaticEncoder.from_folder(packaged) if packaged and os.path.isfile(os.path.join(packaged, "model.safetensors")) else None


def encode(texts: DataFrame, encoder: StaticEncoder, text_col: str = "text") -> DataFrame:
    """texts with `v`, in Arrow batches; equal texts of a batch are encoded once."""
    kind = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes)

    def run(batches):
        for pdf in batches:
            known = {t: encoder.vector(t) for t in pdf[text_col].unique()}
            yield pdf.assign(v=[known[t] for t in pdf[text_col]])

    return texts.mapInPandas(run, f"{kind}, v array<float>")


def facets(nodes: DataFrame) -> DataFrame:
    """(id, text): what a node says of itself (name and doc, or summary), and what tests and commits say."""
    a = F.col("attributes")

    def said(key: str) -> Column:
        return F.coalesce(F.trim(a[key]), F.lit(""))

    simple = F.regexp_extract("name", r"([^.]+)\.?$", 1)
    words = F.regexp_replace(simple, "(?<!^)(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])", " ")
    more = F.when(said("doc") != "", F.concat(F.lit(". "), said("doc"))).when(said("claim.summary") != "", F.concat(F.lit(". "), said("claim.summary"))).otherwise("")
    parts = F.filter(F.array(F.concat(words, more), said("behaviour"), said("history")), lambda x: x != "")
    return nodes.select("id", F.explode(parts).alias("text"))
