"""What a packing task holds: documents handed over at once, and the transducer's table."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumenframe.llm import packing, transducer
from lumenframe.llm.token_counts import vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["apple", "strange", "Über", "running", "zq", "müssen", "don't", "x", "counter", "naïve", "tokens", "data"]


def test_documents_come_in_groups(spark, monkeypatch):
    name, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.written

    def noted(df, where):
        seen.append(int(spark.conf.get(name)))
        return written(df, where)
    monkeypatch.setattr(packing, "written", noted)
    before = spark.conf.get(name)
    docs = spark.range(30).selectExpr("id as doc_id", "repeat('some words ', int(id)) as text")
    assert packing.pack(docs, PATH).select("doc_id").distinct().count() == 30
    assert seen == [packing.GROUP] and spark.conf.get(name) == before


def test_the_table_is_little_larger_than_its_states():
    machine = transducer.Transducer(vocabulary(PATH))
    for n in range(1 << 14):
        machine.state_of(("state", n), n)
    assert len(machine.keys) <= len(machine.table) == len(machine.last) <= 1.3 * len(machine.keys)
    assert (machine.last[2:len(machine.keys)] == range(1 << 14)).all()


def test_states_take_room_for_their_transitions_only():
    docs = [f"{a} {b}s, {a * 3}{b}! {a.title()}'ll 1{i} ß漢 {b.upper()}" for i, (a, b) in enumerate((a, b) for a in WORDS for b in WORDS)]
    machine, whole = transducer.Transducer(vocabulary(PATH)), Tokenizer.from_file(PATH)
    expected = [e.ids for e in whole.encode_batch(docs, add_special_tokens=False)]
    assert machine.ids(docs)[0].tolist() == sum(expected, [])
    assert machine.counts(docs).tolist() == [len(e) for e in expected]
    # With 4,096 rows at least; a row of all bytes would take 1,024 bytes.
    arrays = [a.nbytes for name, a in vars(machine).items() if isinstance(a, np.ndarray) and len(a) >= len(machine.keys) and name not in ("classes", "length", "first", "stop")]
    assert sum(arrays) <= 400 * max(len(machine.keys), 1 << 12)
    # What is remembered along with the states goes when they go.
    machine.restart()
    assert len(machine.keys) == 2 and len(machine.alike) + len(machine.first_of) + len(machine.fits) < 10
    assert machine.ids(docs)[0].tolist() == sum(expected, [])
