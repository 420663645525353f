"""Python holds few rows of a batch at a time, however large the batch."""

import pyarrow as pa

from scholia.operators import alignment, sections


class Rows:
    """Stands for a table: maps one batch and keeps what comes out."""

    def __init__(self, batch):
        self.batch, self.dtypes = batch, [("k", "bigint")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return list(run(iter([self.batch])))


def test_articles_come_in_parts():
    xml = "<article><title>T</title><sec><title>S</title><p>x</p></sec></article>"
    found = sections.section_chunks(Rows(pa.RecordBatch.from_pydict({"name": [str(i) for i in range(1000)], "xml": [xml] * 1000})))
    assert sum(b.num_rows for b in found) == 1000 and max(b.num_rows for b in found) <= sections.PART


def test_examples_come_in_parts():
    n = 1000
    found = alignment.aligned(Rows(pa.RecordBatch.from_pydict({"k": list(range(n)), "ids": [[5]] * n, "labels": [[5]] * n, "bodies": [[[5]]] * n, "credits": [[None]] * n})), "k", set())
    assert [x for b in found for x in b.column("k").to_pylist()] == list(range(n)) and max(b.num_rows for b in found) <= alignment.PART
