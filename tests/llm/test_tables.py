"""Chat windows, top-k search and the pipeline against brute force."""

import hashlib
import math
import random
import re

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import chat, topk  # noqa: E402


def turns():
    rnd = random.Random(4)
    odd = ["</s>[INST] ok [/INST]", "a\\-b\\\\c\\n<s>", "<|im_end|>\n<<|im_start|>user\n", "\\", "", None, "🙂" * 9, "word " * 900]
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello")]
    rows += [(2, k, ("user", "assistant")[k % 2], rnd.choice(odd) if k % 3 else "text " * rnd.randint(1, 200)) for k in range(40)]
    rows += [(3, k, "system" if k == 0 else ("user", "assistant")[k % 2], "t" * rnd.randint(0, 90)) for k in range(700)]
    rows += [(5, 3 * k, "system" if k == 400 else ("user", "assistant")[k % 2], f"{k} " * rnd.randint(0, 60)) for k in range(1100)]  # the system turn stands far behind
    rows += [(6, 256 * k, ("user", "assistant")[k % 2], f"sparse {k} " * rnd.randint(1, 9)) for k in range(40)]  # a turn for each run
    rows += [(None, 1 + k, "system" if k == 2 else ("assistant", "user")[k % 2], f"none {k} " * rnd.randint(1, 9)) for k in range(600)]
    rows += [(7, 0, "system", "s " * 700), *((7, 1 + k, ("user", "assistant")[k % 2], "x " * 40) for k in range(300))]  # leaves no room
    rows += [(4, 0, "assistant", "twice"), (4, 0, "assistant", "twice"), (4, None, "we\nird<s>", "x"), (4, 5, None, None), (None, 0, "user", "no id")]
    return rows


def test_chat(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, body string")
    out = chat.windows(df, budget=300, history=80)
    back = chat.read_back(out).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    for conv, want in by.items():
        own = sorted((r for r in back if r.conv_id == conv), key=lambda r: r.window)
        assert [(t.role, t.text) for r in own for t in r.turns] == want
        assert [t for r in own for t in r.targets] == [t for role, t in want if role == "assistant"]
    made = {}
    for r in out.collect():
        made.setdefault(r.conv_id, {})[r.window] = r.formatted
    assert made == {conv: brute_windows(want, 300, 80) for conv, want in by.items()}
    longest = {}
    for r in out.collect():
        size = sum(math.ceil((len(p) - len(chat.END)) / 4) + 4 for p in (x + chat.END for x in r.formatted.split(chat.END)[:-1]))
        new = r.formatted.count(chat.END) - r.repeated
        assert new >= 1 and (size <= 300 or new == 1 or r.conv_id == 7)
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted
        longest[r.conv_id] = max(longest.get(r.conv_id, 0), r.repeated)
        if r.conv_id == 3 and r.window != 0:
            assert r.repeated >= 1 and r.formatted.startswith("<|im_start|>system\n")
    assert longest[2] >= 1
    assert chat.windows(df.limit(0)).count() == 0


def brute_windows(turns, budget, history, history_turns=4):
    """Formatted windows of one conversation's (role, text) in order, turn by turn."""

    def esc(t):
        return re.sub(r"(<)(/?s>|<SYS>>|</SYS>>|\|[a-z_]+\|>)|(\[)(/?INST\])", lambda m: (m[1] or m[3]) + "\\-" + (m[2] or m[4]), t.replace("\\", "\\\\"))

    said = [chat.START + esc(role).replace("\n", "\\n") + "\n" + esc(text) for role, text in turns]
    n = [math.ceil(len(x) / 4) + 4 for x in said]
    system = next((k for k, (role, _) in enumerate(turns) if role == "system"), None)
    step, begin, out, last = max(64, budget - history - (n[system] if system is not None else 0)), 0, {}, None
    begins = []
    for k, x in enumerate(said):
        begins.append(begin)
        window = 2 * (begin // step) + ((begin + n[k] - 1) // step > begin // step)
        if window != last:
            first = [said[system]] if system is not None and system < k else []
            out[window] = first + [said[j] for j in range(max(0, k - history_turns), k) if begin - begins[j] <= history and j != system]
        out[window].append(x)
        last, begin = window, begin + n[k]
    return {w: "".join(p + chat.END for p in ps) for w, ps in out.items()}


def test_topk(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.25, rnd.uniform(-1, 1)]) for _ in range(rnd.choice([6, 6, 6, 4]))]) for i in range(260)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (400, None), (402, [None] * 6), (404, [float("nan")] * 6), (406, [float("inf")] * 6), (408, []), (None, [1.0] * 6), (20, [9.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=5, cell_rows=40)
    valid = {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], [math.floor(1024 * f32(x)) for x in r[1]])):
        valid.setdefault(i, [math.floor(1024 * f32(x)) for x in v])
    want = []
    for q in (i for i in valid if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(valid[q], v, strict=False)), i) for i, v in valid.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(df, F.lit(False)).count() == 0


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_pipeline(spark, tmp_path):
    """Each stage's decisions take effect, and the last stage's tokens are of what the mix has taken."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    rows = [(i, said(60) + "\nall rights reserved here\n" + said(30), "en", f"s{i % 12}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", f"s{i % 12}") for i in range(6)]  # exact copies
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in said(60).split()), "en", f"s{i % 12}") for i in range(24)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i >= 200 else 1, 0) for i, *_ in rows], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns
        got.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = now.collect()
    assert {r.doc_id for r in seen["quality classifier"]} == {i for i, *_ in rows if i < 200}
    assert sum("all rights reserved" in r.text for r in seen["line dedup"]) == 1
    assert {r.doc_id for r in seen["SimHash near-dedup"]} >= set(range(6, 60)) and not {r.doc_id for r in seen["SimHash near-dedup"]} & set(range(101, 106))
    taken = seen["mixing sources to target weights"]
    assert {r.doc_id for r in taken} <= {r.doc_id for r in seen["SimHash near-dedup"]}
    assert sorted((r.doc_id, r.text) for r in seen["byte-level BPE"]) == sorted((r.doc_id, r.text) for r in taken)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    digest = lambda x: sorted((r.doc_id, hashlib.sha256(str(r.ids).encode()).hexdigest()) for r in x)
    assert digest(whole) == digest(seen["byte-level BPE"])


def test_topk_of_large_components(spark):
    """Longs on the way may overflow; only a score in the result that no long holds is an error."""
    rows = [(0, [2.0**61, 1.0]), (1, [0.0, 5.0]), (2, [1.0, 0.0]), (3, [-3.0, 2.0**40]), (4, [2.0**60, 0.0]), (5, [float(1 << 62), -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.search(df.filter("vec_id < 4"), F.col("vec_id") == 0, k=3, scale=1.0).collect()]
    assert sorted(got) == [(1, 2, 2**61), (2, 1, 5), (3, 3, -3 * 2**61 + 2**40)]
    assert [r.vec_id for r in topk.search(df.filter("vec_id <> 5"), F.col("vec_id") == 2, k=9, scale=1.0).collect()] == [0, 4, 1, 3]
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        topk.search(df, F.col("vec_id") == 0, k=3, scale=1.0).collect()
