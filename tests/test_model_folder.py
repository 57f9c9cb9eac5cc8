"""The model scorer, with a tiny model written by hand: the logits are multiples of the mean id."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import predict
from textloom.operators.classify import ModelFolder, scored, warm
from textloom.operators.roberta import read_weights
from textloom.sources import tables

FACTORS = (-1.0, 0.5, 0.25)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _part(field: int, value: bytes | str) -> bytes:
    value = value.encode() if isinstance(value, str) else value
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _value(name: str, kind: int, *dims: str | int) -> bytes:
    shape = b"".join(_part(1, _part(2, d) if isinstance(d, str) else _number(1, d)) for d in dims)
    return _part(1, name) + _part(2, _part(1, _number(1, kind) + _part(2, shape)))


def _node(op: str, inputs: list[str], output: str, attributes: bytes = b"") -> bytes:
    return _part(1, b"".join(_part(1, i) for i in inputs) + _part(2, output) + _part(4, op) + attributes)


def tiny_model() -> bytes:
    """mean(ids * mask) over the whole length, times three factors."""
    to_float = _part(5, _part(1, "to") + _number(3, 1) + _number(20, 2))
    factors = _number(1, 1) + _number(1, 3) + _number(2, 1) + _part(8, "factors") + _part(9, struct.pack("<3f", *FACTORS))
    graph = (
        _node("Mul", ["input_ids", "attention_mask"], "seen") + _node("Cast", ["seen"], "real", to_float) + _node("ReduceSum", ["real", "axis"], "sum") + _node("Mul", ["sum", "factors"], "logits")
        + _part(2, "tiny") + _part(5, factors) + _part(5, _number(1, 1) + _number(2, 7) + _part(8, "axis") + _part(9, struct.pack("<q", 1)))
        + _part(11, _value("input_ids", 7, "n", "l")) + _part(11, _value("attention_mask", 7, "n", "l")) + _part(12, _value("logits", 1, "n", 3))
    )
    return _number(1, 8) + _part(8, _part(1, "") + _number(2, 13)) + _part(7, graph)


@pytest.fixture
def folder(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"<unk>": 0, "<pad>": 1, "one": 2, "left": 3, "two": 4}, unk_token="<unk>"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "model.onnx").write_bytes(tiny_model())
    return str(tmp_path)


def test_model_scores_segments(spark, folder):
    df = spark.createDataFrame([(1, "none none"), (2, "one two"), (3, "one " * 600), (4, None)], "request_id long, text string")
    got = {r.request_id: r for r in scored(df, ModelFolder(folder)).collect()}
    # Padding doesn't count: ids 2 and 4 sum to 6, and 600 words are cut to 512.
    assert got[1].label == "LEFT" and got[1].p_left == pytest.approx(1 / 3, abs=1e-6)
    assert got[2].label == "RIGHT" and got[2].p_right > got[2].p_center > got[2].p_left
    assert got[4].label == "LEFT"
    logits = {r.request_id: r.z0 for r in ModelFolder(folder).logits(df, "text").collect()}
    assert logits[2] == -6.0 and logits[3] == -1024.0


def test_model_in_the_whole_flow(spark, folder):
    warm(spark, ModelFolder(folder))
    df = spark.createDataFrame([(1, "One two. Two one."), (2, "")], "request_id long, input string").withColumn("mode", F.lit("sentence"))
    got = {r.request_id: r for r in predict.responses(df, scorer=ModelFolder(folder)).collect()}
    assert [x.segment_index for x in got[1].results] == [0, 1] and got[2].results is None
    rows = tables.ordered(predict.predictions(df, scorer=ModelFolder(folder))).collect()
    assert [r.segment_index for r in rows] == [0, 1]


def test_refused_texts_fail_their_own_request(spark, tmp_path, folder):
    from tokenizers import Tokenizer, models, pre_tokenizers

    strict = Tokenizer(models.WordLevel({"<pad>": 1, "one": 2, "two": 4}, unk_token="<unk>"))  # refuses other words
    strict.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    strict.save(str(tmp_path / "tokenizer.json"))
    model = ModelFolder(folder)
    given = [(1, "one two"), (2, "one\n\nother\n\ntwo"), (3, "two\n\none"), (4, "")]
    df = spark.createDataFrame(given, "request_id long, input string").withColumn("mode", F.lit("paragraph"))
    got = {r.request_id: r for r in predict.responses(df, scorer=model).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == [200, 400, 200, 422]
    assert got[2].results is None and "UNK" in got[2].error and got[1].error is None and len(got[3].results) == 2
    assert sorted((r.request_id, r.segment_index) for r in predict.predictions(df, scorer=model).collect()) == [(1, 0), (3, 0), (3, 1)]
    assert predict.log_failures(predict.responses(df, scorer=model)) == 2
    with pytest.raises(RuntimeError, match="can't score"):
        warm(spark, model)


def test_logits_of_a_transformer_sized_batch(spark, folder):
    """The export contract: int64 ids and mask of one shape, three logits, whatever the length of the texts."""
    df = spark.range(70).select("id", F.expr("repeat('two ', cast(1 + id % 9 as int))").alias("text"))
    got = {r.id: r.z0 for r in ModelFolder(folder).logits(df, "text").collect()}
    assert got == {i: -4.0 * (1 + i % 9) for i in range(70)}


# A tiny RoBERTa: weights saved in the training library's layout, logits worked out value by value.

CONFIG = {"model_type": "roberta", "hidden_act": "gelu", "hidden_size": 8, "intermediate_size": 12, "num_attention_heads": 2, "num_hidden_layers": 2, "layer_norm_eps": 1e-5, "pad_token_id": 1, "vocab_size": 9}


def tiny_weights(form: str = "F32") -> tuple[dict, bytes]:
    rng = np.random.default_rng(11)
    shapes = {"roberta.embeddings.word_embeddings.weight": (9, 8), "roberta.embeddings.position_embeddings.weight": (600, 8), "roberta.embeddings.token_type_embeddings.weight": (1, 8)}
    both = lambda name, *shape: {f"{name}.weight": shape, f"{name}.bias": shape[:1]}
    shapes |= both("roberta.embeddings.LayerNorm", 8) | both("classifier.dense", 8, 8) | both("classifier.out_proj", 3, 8)
    for i in range(2):
        at = f"roberta.encoder.layer.{i}"
        for part in ("query", "key", "value"):
            shapes |= both(f"{at}.attention.self.{part}", 8, 8)
        shapes |= both(f"{at}.attention.output.dense", 8, 8) | both(f"{at}.attention.output.LayerNorm", 8) | both(f"{at}.output.LayerNorm", 8)
        shapes |= both(f"{at}.intermediate.dense", 12, 8) | both(f"{at}.output.dense", 8, 12)
    arrays = {name: rng.normal(size=shape).astype({"F32": np.float32, "F16": np.float16}[form]) for name, shape in shapes.items()}
    header, body = {"__metadata__": {"format": "pt"}}, b""
    for name, a in arrays.items():
        header[name] = {"dtype": form, "shape": list(a.shape), "data_offsets": [len(body), len(body) + a.nbytes]}
        body += a.tobytes()
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)
    return arrays, struct.pack("<Q", len(text)) + text + body


def plain_logits(w: dict, ids: list[int]) -> list[float]:
    """One text, without padding, by loops over plain numbers."""
    w = {k: v.astype(float).tolist() for k, v in w.items()}
    linear = lambda x, n: [sum(a * b for a, b in zip(row, x, strict=True)) + bias for row, bias in zip(w[f"{n}.weight"], w[f"{n}.bias"], strict=True)]

    def norm(x, n):
        mean = sum(x) / len(x)
        spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x) + 1e-5)
        return [(v - mean) / spread * g + b for v, g, b in zip(x, w[f"{n}.weight"], w[f"{n}.bias"], strict=True)]

    add = lambda *xs: [sum(v) for v in zip(*xs, strict=True)]
    e = "roberta.embeddings"
    xs = [norm(add(w[f"{e}.word_embeddings.weight"][t], w[f"{e}.position_embeddings.weight"][2 + i], w[f"{e}.token_type_embeddings.weight"][0]), f"{e}.LayerNorm") for i, t in enumerate(ids)]
    for layer in range(2):
        at = f"roberta.encoder.layer.{layer}"
        q, k, v = ([linear(x, f"{at}.attention.self.{p}") for x in xs] for p in ("query", "key", "value"))
        out = []
        for i, x in enumerate(xs):
            mixed = []
            for h in (slice(0, 4), slice(4, 8)):
                s = [math.exp(sum(a * b for a, b in zip(q[i][h], kj[h], strict=True)) / 2) for kj in k]
                mixed += [sum(sj * vj[h][d] for sj, vj in zip(s, v, strict=True)) / sum(s) for d in range(4)]
            x = norm(add(x, linear(mixed, f"{at}.attention.output.dense")), f"{at}.attention.output.LayerNorm")
            inner = [u * 0.5 * (1 + math.erf(u / math.sqrt(2))) for u in linear(x, f"{at}.intermediate.dense")]
            out.append(norm(add(x, linear(inner, f"{at}.output.dense")), f"{at}.output.LayerNorm"))
        xs = out
    return linear([math.tanh(v) for v in linear(xs[0], "classifier.dense")], "classifier.out_proj")


@pytest.fixture(params=["F32", "F16"])
def roberta(tmp_path, request):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    words = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "a": 4, "b": 5, "c": 6, "d": 7, "e": 8}
    tokenizer = Tokenizer(models.WordLevel(words, unk_token="<unk>"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tokenizer.post_processor = processors.TemplateProcessing(single="<s> $A </s>", special_tokens=[("<s>", 0), ("</s>", 2)])
    tokenizer.enable_padding(length=512, pad_id=1, pad_token="<pad>")
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    arrays, saved = tiny_weights(request.param)
    (tmp_path / "model.safetensors").write_bytes(saved)
    return str(tmp_path), arrays


def test_roberta_from_saved_weights(spark, roberta):
    folder, arrays = roberta
    texts = ["a b c", "", "d", "e e e a b zz " * 3, "c " * 40]
    ids = lambda t: [0, *({"a": 4, "b": 5, "c": 6, "d": 7, "e": 8}.get(x, 3) for x in t.split()), 2]
    df = spark.createDataFrame(list(enumerate([*texts, "b " * 700])), "request_id long, text string").repartition(2)
    got = {r.request_id: (r.z0, r.z1, r.z2) for r in ModelFolder(folder).logits(df, "text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_logits(arrays, ids(t)), abs=2e-4)
    assert got[5] == pytest.approx(plain_logits(arrays, [0, *[5] * 510, 2]), abs=2e-3)  # cut to 512 with both ends
    labels = {r.request_id: r for r in scored(df, ModelFolder(folder)).collect()}
    best = np.argmax(plain_logits(arrays, ids(texts[0])))
    assert labels[0].label == ("LEFT", "RIGHT", "CENTER")[best] and labels[0].p_left + labels[0].p_right + labels[0].p_center == pytest.approx(1, abs=3e-6)


def test_pointer_files_are_refused(tmp_path):
    (tmp_path / "model.safetensors").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 9\n")
    with pytest.raises(ValueError, match="pointer"):
        read_weights(tmp_path / "model.safetensors")
