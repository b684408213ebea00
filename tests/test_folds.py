"""Nesting in files against plain loops, and long files."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from corpusgraph.operators import folds, outline, relate


def test_block_spans_equal_loop():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 40)
        no = np.cumsum([rng.randint(1, 3) for _ in range(n)])
        indent, is_class = np.array([rng.randint(0, 4) for _ in range(n)]), np.array([rng.random() < 0.3 for _ in range(n)])
        head = np.array(sorted(rng.sample(range(n), rng.randint(0, n))), np.int64)
        end, method = folds.block_spans(no, indent, is_class, no[head] if len(head) else head, 999)
        for k, h in enumerate(head):
            after = [no[j] - 1 for j in range(h + 1, n) if indent[j] <= indent[h]]
            above = [is_class[j] for j in range(h) if (indent[j] < indent[h] if is_class[j] else indent[j] <= indent[h])]
            assert end[k] == (after[0] if after else 999) and method[k] == bool(above and above[-1])


def test_brace_ends_equal_loop():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 40)
        brace_no = np.array(sorted(rng.randint(1, 15) for _ in range(n)), np.int64)
        step = np.array([rng.choice([1, -1]) for _ in range(n)], np.int64)
        head = np.array(sorted(rng.randint(1, 16) for _ in range(rng.randint(0, 6))), np.int64)
        got = folds.brace_ends(brace_no, step, head, 77)
        for k, h in enumerate(head):
            depth, want = 0, 77
            for line, s in zip(brace_no, step):
                if line >= h:
                    depth += s
                    if s < 0 and depth == 0:
                        want = line
                        break
            assert got[k] == want


def test_smallest_around_equals_loop():
    rng = random.Random(4)
    for _ in range(400):
        spans = sorted((s := rng.randint(1, 12), s + rng.randint(0, 12)) for _ in range(rng.randint(0, 25)))
        rng.shuffle(spans)
        spans.sort(key=lambda x: x[0])
        got = folds.smallest_around(np.array([s for s, _ in spans], np.int64), np.array([e for _, e in spans], np.int64))
        for i, (_, e) in enumerate(spans):
            around = [(spans[p][1] - spans[p][0], p) for p in range(i) if spans[p][1] >= e]
            assert got[i] == (min(around)[1] if around else -1)


def test_long_files_take_seconds(spark):
    python = "\n".join(f"class C{i}:\n    def m{i}(self):\n        return {i}\n" for i in range(25_000))
    script = "\n".join(f"class C{i} {{\n  run{i}(x) {{\n    y = x\n  }}\n}}" for i in range(20_000))
    files = spark.createDataFrame([("a.py", "p", "python", python), ("b.js", "p", "javascript", script)],
                                  "path string, project_id string, language string, content string")
    began = time.time()
    chunks = outline.outline(files)
    got = {r[0]: r[1] for r in chunks.groupBy("node_type").count().collect()}
    assert got["class_definition"] == 45_000 and got["method_definition"] == 25_000 and got["function_definition"] == 20_000
    inside = relate.containment_parent(chunks).join(chunks.filter("node_type = 'method_definition'").select("id"), "id")
    assert inside.count() == 25_000
    assert time.time() - began < 60


def test_odd_files(spark):
    files = spark.createDataFrame([("e.py", "p", "python", ""), ("n.py", "p", "python", None), ("o.js", "p", "javascript", "}\n{"),
                                   ("c.py", "p", "python", "class A: x\n\n")],
                                  "path string, project_id string, language string, content string")
    got = [(r.file_path, r.name, r.start_line, r.end_line) for r in outline.outline(files).collect()]
    assert got == [("c.py", "A", 1, 3)]
    assert relate.containment_parent(outline.outline(files)).count() == 0
    assert outline.outline(files.filter(F.lit(False))).count() == 0


def test_texts_are_unpacked_and_handed_back_in_parts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    files = []
    for i in range(60):
        text = "\n".join(f"class C{j}:\n    def m{j}(self):\n        return {'x' * rng.randint(0, 60)}" for j in range(rng.randint(0, 6)))
        lines = text.split("\n")
        solid = [(n + 1, len(s) - len(s.lstrip()), s.startswith("class ")) for n, s in enumerate(lines) if s.strip()]
        heads = {w: [(n + 1, s.split()[1][:2]) for n, s in enumerate(lines) if s.strip().startswith(w)] for w in ("class ", "def ")}
        files.append({"path": f"f{i}", "project_id": None, "language": "python", "content": text if i % 7 else None,
                      "_classes": [n for n, _ in heads["class "]] if i % 7 else None, "_class_names": [x for _, x in heads["class "]] if i % 7 else None,
                      "_functions": [n for n, _ in heads["def "]] if i % 7 else None, "_function_names": [x for _, x in heads["def "]] if i % 7 else None,
                      "_no": [a for a, _, _ in solid] if i % 7 else None, "_indent": [b for _, b, _ in solid] if i % 7 else None,
                      "_is_class": [c for _, _, c in solid] if i % 7 else None})
    ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
    batch = pa.RecordBatch.from_pylist(files, schema=pa.schema([
        ("path", pa.string()), ("project_id", pa.string()), ("language", pa.string()), ("content", pa.string()), ("_classes", ints),
        ("_class_names", strings), ("_functions", ints), ("_function_names", strings), ("_no", ints), ("_indent", ints),
        ("_is_class", pa.list_(pa.bool_()))]))
    run = lambda: list(folds.block_chunks(iter([batch.slice(0, 0), batch.slice(1, 30), batch.slice(31)])))
    whole = run()
    monkeypatch.setattr(folds, "PART_BYTES", 600)
    parts = run()
    assert len(whole) == 1 and len(parts) > 10 and max(b.num_rows for b in parts) <= 6
    rows = [r for b in parts for r in b.to_pylist()]
    assert rows == whole[0].to_pylist() and len(rows) == sum(len(f["_no"] or []) // 3 * 2 for f in files[1:])
    text = {f["path"]: f["content"] for f in files}
    for r in rows:
        assert r["content"] == "\n".join(text[r["path"]].split("\n")[r["start_line"] - 1:r["end_line"]])
        assert r["end_line"] - r["start_line"] == (2 if r["node_type"] == "class_definition" else 1)
