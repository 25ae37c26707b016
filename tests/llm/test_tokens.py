"""Token counts (4) and token ids as ORC (9) against the library."""

import zlib

import numpy as np
import pyarrow.orc as orc
from llm_fixtures import BYTE_BPE, ODD_ROWS
from tokenizers import Tokenizer

from tessera.llm import token_counts, token_output

LIBRARY = Tokenizer.from_file(BYTE_BPE)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def expected_counts(rows):
    return sorted((str(d), len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for d, t in rows)


def counted(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


def test_counts(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    assert counted(token_counts.token_counts(corpus, BYTE_BPE)) == expected_counts(rows)


def test_counts_of_rare_pretokens_come_through_the_join(odd_documents):
    assert counted(token_counts.token_counts(odd_documents, BYTE_BPE, head_limit=3)) == expected_counts([r[:2] for r in ODD_ROWS])


def test_counts_of_nothing(no_documents):
    assert token_counts.token_counts(no_documents, BYTE_BPE).count() == 0


def expected_ids(rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = np.array([*ids(t), 0], "<u4")
        out.append((str(d), start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    return sorted(out)


def digests(df):
    return sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in df.collect())


def test_ids_round_trip(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    assert digests(token_output.round_trip(corpus.repartition(5), BYTE_BPE)) == expected_ids(rows)


def test_ids_of_odd_rows(odd_documents, no_documents):
    assert digests(token_output.round_trip(odd_documents, BYTE_BPE)) == expected_ids([r[:2] for r in ODD_ROWS])
    assert token_output.round_trip(no_documents, BYTE_BPE).count() == 0


def stripe_parts(spark, file):
    """Kinds of the streams in a file's first stripe, and the encodings of its columns."""
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    return {str(s.getKind()) for s in footer.getStreamsList()}, [str(c.getKind()) for c in footer.getColumnsList()]


def test_file_format(spark, corpus, tmp_path, capsys):
    path = token_output.write_token_ids(corpus, str(tmp_path / "ids"), BYTE_BPE)
    files = sorted((tmp_path / "ids").glob("*.orc"))
    assert files
    last = -1
    for f in files:  # ascending ids, within files and from file to file
        got = orc.ORCFile(f).read().column("doc_id").to_pylist()
        assert got == sorted(got) and (not got or got[0] > last)
        last = got[-1] if got else last
    kinds, encodings = stripe_parts(spark, str(files[0]))
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    assert encodings[1] == "DIRECT_V2" and encodings[-1] == "DIRECT_V2"  # run-length encoded integers
    stored = token_output.read_token_ids(spark, path).where("doc_id = 17")
    assert [r.ids for r in stored.collect()] == [[*ids(corpus.where("doc_id = 17").first().text), 0]]
    stored.explain("formatted")
    assert "EqualTo(doc_id,17)" in capsys.readouterr().out
