"""The pipeline against a plain version, and the library without the pipeline's parts."""

import math
import shutil
import string
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quarry.llm import pii


def plain(rows):
    """Texts after the first four stages, as (doc_id, text)."""

    def passes(t):
        n, chars, symbols, dup, again = brute.quality(t)
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        marks = sum(c in string.punctuation + string.digits for c in t or "")
        return not (n < 1 or 100 * again > 50 * n or 3 * symbols > n or chars < 2 * n or chars > 20 * n or (len(lines) >= 4 and 2 * dup > len(lines)) or 2 * marks > chars)

    rows = [r for r in rows if passes(r[1])]
    rows = [key for key, (_, c) in brute.components(rows, 5, 80).items() if c == key[0]]
    gone = brute.removed(rows)
    cut = []
    for i, t in rows:
        flags = gone[i, t]
        cut.append((i, t if not any(flags) else " ".join(w for w, g in zip(brute.words(t), flags, strict=True) if not g)))
    return [(i, pii.mask(t, brute.joined(brute.personal(t)), [], 1)) for i, t in cut if t]


def test_stages(spark, tables, rows):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.schema == columns, name
        docs = spark.createDataFrame(docs.collect(), columns)
    got = docs.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(plain(rows))
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_run(spark, tables, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t in plain(rows):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, tables).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected)
    bins = defaultdict(int)
    for r in got:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and len(bins) == math.ceil(sum(bins.values()) / 4096)


def test_the_rest_works_without_these_folders(tmp_path):
    root = Path(__file__).resolve().parent.parent.parent
    shutil.copytree(root / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names and not any(n.startswith('op') or n == 'pipeline' for n in names); assert set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
