"""What a Python worker keeps between tasks goes when another operator starts there."""

import numpy as np
import pyarrow as pa

from pactum.llm import language_id, piece_encoding
from pactum.llm.lattice import PieceTable


def test_language_tasks_drop_a_kept_dictionary(spark, monkeypatch):
    docs, tasks = spark.createDataFrame([(1, "ab a")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: tasks.append(task) or self)
    language_id.predict(docs, language_id.Model(["x"], PieceTable(["a", "b"]), np.ones((2, 1)) / 2))
    piece_encoding._HELD["somewhere"] = (1,)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["ab a"])], ["doc_id", "text"])
    rows = [r for out in tasks[0](iter([batch])) for r in out.to_pylist()]
    assert [r["lang_pred"] for r in rows] == ["x"] and not piece_encoding._HELD
