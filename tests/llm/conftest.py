import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
DATA = "/root/testdata/sf0.001"
ODD = ["", None, "   ", "a", "a b c", "İstanbul ǅ it's 12 ½ Σας", "x\x00y\x1c z\xa0w", "日本語 カタカナ 😀 é", "a<|endoftext|>b <|ENDOFTEXT|>", "!!!!" * 500 + "we'll 'sss", " \n \n▁a▁▁b", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    some = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(*r, "x") for r in some] + [(10_000 + i, t, None) for i, t in enumerate(ODD)] + [(*some[0], "x"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3).cache()
