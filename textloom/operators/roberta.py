"""A RoBERTa sequence classifier in NumPy, read from the folder that its training saves.

The folder holds ``config.json``, ``model.safetensors`` and ``tokenizer.json``. Weights are mapped into memory,
once in each Python worker, so workers of one machine share their pages. Padding is masked out of
the attention, so a batch is padded to its longest text only.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

import numpy as np

# Number formats of the weights file that are read.
_FORMATS = {"F64": np.float64, "F32": np.float32, "F16": np.float16, "I64": np.int64, "I32": np.int32}
#: Tokens, padding included, that go through the layers at a time.
TOKENS = 8192


def read_weights(path: str | Path) -> dict[str, np.ndarray]:
    """Name -> array of a safetensors file: eight bytes of header size, a JSON header, then the numbers."""
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    size = int.from_bytes(raw[:8].tobytes(), "little") if len(raw) >= 8 else 0
    if not 2 <= size <= len(raw) - 8:
        raise ValueError(f"not a weights file: {path} (a pointer to one must be resolved first)")
    header = json.loads(raw[8 : 8 + size].tobytes())
    out = {}
    for name, about in header.items():
        if name == "__metadata__":
            continue
        begin, end = (8 + size + x for x in about["data_offsets"])
        if about["dtype"] == "BF16":  # the upper half of a float32
            wide = raw[begin:end].view(np.uint16).astype(np.uint32) << np.uint32(16)
            out[name] = wide.view(np.float32).reshape(about["shape"])
        elif about["dtype"] in _FORMATS:
            out[name] = raw[begin:end].view(_FORMATS[about["dtype"]]).reshape(about["shape"])
        else:
            raise ValueError(f"number format {about['dtype']} of {name} isn't read")
    return out


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function by the rational approximation of Abramowitz and Stegun 7.1.26: off by at most 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def _gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + _erf(x / math.sqrt(2)))


class Roberta:
    """Logits from ids and mask. Weights have the names that the common training library gives them."""

    def __init__(self, folder: str | Path):
        self.config = json.loads((Path(folder) / "config.json").read_text())
        if self.config.get("model_type") != "roberta" or self.config.get("hidden_act", "gelu") != "gelu":
            raise ValueError("only RoBERTa with GELU is read")
        self.weights = read_weights(Path(folder) / "model.safetensors")
        self.eps = self.config.get("layer_norm_eps", 1e-5)
        self.heads = self.config["num_attention_heads"]
        self.pad = self.config.get("pad_token_id", 1)

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.weights[f"{name}.weight"].T.astype(np.float32, copy=False) + self.weights[f"{name}.bias"]

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        spread = np.sqrt((centred * centred).mean(-1, keepdims=True) + self.eps)
        return centred / spread * self.weights[f"{name}.weight"] + self.weights[f"{name}.bias"]

    def _attention(self, x: np.ndarray, bias: np.ndarray, name: str) -> np.ndarray:
        rows, length, width = x.shape
        split = lambda part: self._linear(x, f"{name}.self.{part}").reshape(rows, length, self.heads, -1).transpose(0, 2, 1, 3)
        query, key, value = map(split, ("query", "key", "value"))
        scores = query @ key.transpose(0, 1, 3, 2) / math.sqrt(width // self.heads) + bias
        scores = np.exp(scores - scores.max(-1, keepdims=True))
        mixed = (scores / scores.sum(-1, keepdims=True)) @ value
        mixed = mixed.transpose(0, 2, 1, 3).reshape(rows, length, width)
        return self._norm(x + self._linear(mixed, f"{name}.output.dense"), f"{name}.output.LayerNorm")

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits, one row for each row of ids."""
        w, base = self.weights, "roberta.embeddings"
        real = (ids != self.pad).astype(np.int64)
        places = np.cumsum(real, 1) * real + self.pad
        x = w[f"{base}.word_embeddings.weight"][ids].astype(np.float32) + w[f"{base}.position_embeddings.weight"][places] + w[f"{base}.token_type_embeddings.weight"][0]
        x = self._norm(x, f"{base}.LayerNorm")
        bias = np.where(mask[:, None, None, :] > 0, np.float32(0), np.float32(-1e30))
        for i in range(self.config["num_hidden_layers"]):
            layer = f"roberta.encoder.layer.{i}"
            x = self._attention(x, bias, f"{layer}.attention")
            x = self._norm(x + self._linear(_gelu(self._linear(x, f"{layer}.intermediate.dense")), f"{layer}.output.dense"), f"{layer}.output.LayerNorm")
        first = np.tanh(self._linear(x[:, 0], "classifier.dense"))
        return self._linear(first, "classifier.out_proj")

    def in_parts(self, encoded: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """Logits of texts of any lengths: those of like length together, ``TOKENS`` at a time, each part padded to its longest."""
        order = sorted(range(len(encoded)), key=lambda i: len(encoded[i][0]))
        out = np.zeros((len(encoded), self.weights["classifier.out_proj.bias"].shape[0]), dtype=np.float64)
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * len(encoded[order[stop]][0]) <= TOKENS:
                stop += 1
            part = order[at:stop]
            longest = max([1, *(len(encoded[i][0]) for i in part)])
            ids = np.full((len(part), longest), self.pad, dtype=np.int64)
            mask = np.zeros((len(part), longest), dtype=np.int64)
            for row, i in enumerate(part):
                n = len(encoded[i][0])
                ids[row, :n], mask[row, :n] = encoded[i]
            out[part] = self(ids, mask)
            at = stop
        return out
