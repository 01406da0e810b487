import gzip
import random

import pytest
from conftest import G1, G2, G3, G4, G5, R
from pyspark.sql import functions as F

from seqgrove.sources import config, download, flatfiles, tables

OBO = f"""format-version: 1.2

[Term]
id: {R}
name: molecular_function
namespace: molecular_function

[Term]
id: {G1}
name: parent activity
namespace: molecular_function
is_a: {R} ! molecular_function

[Term]
id: {G2}
name: child activity
namespace: molecular_function
is_a: {G1} ! parent

[Term]
id: {G3}
name: sibling activity
namespace: molecular_function
is_a: {G1}
[Term]
id: {G5}
name: unused activity
namespace: molecular_function
is_a: {G1}

[Term]
id: {G4}
name: old
namespace: molecular_function
is_a: {R}
is_obsolete: true

[Term]
id: GO:0008150
name: biological_process
namespace: biological_process

[Term]
id: GO:0000077
name: adrift
namespace: molecular_function

[Typedef]
id: part_of
"""

KB = f"""ID   ONE
AC   P00001; Q00001;
AC   Q00009;
DR   GO; {G2}; F:child; EXP:UniProt.
DR   GO; {G5}; F:unused; NAS:UniProt.
DR   GO; GO:0000100; P:other; EXP:X.
DR   GO; GO:0000101; C:other.
SQ   SEQUENCE
     MABCD EFG
//
ID   TWO
AC   P00002;
DR   GO; {G3}; F:x; IEA:Y.
DR   GO; {G2}; F:y; ND:Y.
SQ   SEQUENCE
     WXYZ
//
AC   P00003;
DR   GO; {G4}; F:gone; IDA:Z.
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "go.obo").write_text(OBO)
    with gzip.open(tmp_path / "kb.dat.gz", "wt") as f:
        f.write(KB)
    return tmp_path


def test_ontology(spark, files):
    t = flatfiles.read_obo(spark, str(files / "go.obo"))
    assert {r.term_id for r in t.where("obsolete").collect()} == {G4}
    kept, edges = flatfiles.project(t)
    assert {r.term_id: r.depth for r in kept.collect()} == {R: 0, G1: 1, G2: 2, G3: 2, G5: 2}
    assert {r.term_id: r.children for r in flatfiles.children(edges).collect()} == {R: [G1], G1: [G2, G3, G5]}
    with pytest.raises(ValueError):
        flatfiles.project(t, root="GO:7777777")


def test_knowledge_base(spark, files):
    r = flatfiles.read_knowledge_base(spark, str(files / "kb.dat.gz"))
    assert [x.accession for x in r.orderBy("accession").collect()] == ["P00001", "P00002", "P00003"]
    a = flatfiles.annotations(r)
    assert {(x.entity, x.term_id, x.namespace, x.evidence) for x in a.where("entity = 'P00001'").collect()} == {("P00001", G2, "F", "EXP"), ("P00001", G5, "F", "NAS"), ("P00001", "GO:0000100", "P", "EXP")}
    s = flatfiles.sequences(r)
    assert {x.accession: x.sequence for x in s.collect()} == {"P00001": "MABCDEFG", "P00002": "WXYZ"}
    assert flatfiles.lookup(s, "P00002") == "WXYZ" and flatfiles.lookup(s, "Q00001") is None
    assert {x.entity: x.term_ids for x in tables.profiles_of(a).collect()} == {"P00001": [G2], "P00002": [G3], "P00003": [G4]}
    assert {tuple(x) for x in tables.excluded(a).collect()} == {("P00001", G5, "NAS"), ("P00002", G2, "ND")}
    assert flatfiles.to_fasta(s).where(F.col("value").contains("P00002")).first().value == ">P00002\nWXYZ"


def test_prosite(spark, tmp_path):
    (tmp_path / "p.dat").write_text("ID   ASN_GLYC; PATTERN.\nAC   PS00001;\nDE   N-glycosylation site.\nPA   N-{P}-\nPA   [ST]-{P}.\n//\nID   M; MATRIX.\nAC   PS2;\n//\nID   NONE; PATTERN.\nCC\n//\n")
    e = flatfiles.read_prosite(spark, str(tmp_path / "p.dat"))
    r = e.where("name = 'ASN_GLYC'").first()
    assert (r.kind, r.ac, r.description, r.pattern) == ("PATTERN", "PS00001", "N-glycosylation site", "N-{P}-[ST]-{P}")
    assert tuple(flatfiles.prosite_counts(e).first()) == (3, 2, 1)


def test_fasta(spark, tmp_path):
    (tmp_path / "q.fa").write_text("junk\n>q1 words\nxx bb\nXX\n>q2\n>q3\nA\n")
    assert {r["query"]: r.sequence for r in flatfiles.read_fasta(spark, str(tmp_path / "q.fa")).collect()} == {"q1": "XXBBXX", "q2": "", "q3": "A"}


def test_profiles(spark, tmp_path):
    (tmp_path / "p.tsv").write_text(f"P1\t{G2};{G1};{G2}\n\nP2\tx {G3} y\nP1\t{G3}\n")
    assert {r.entity: r.term_ids for r in tables.read_profiles(spark, str(tmp_path / "p.tsv")).collect()} == {"P1": [G3], "P2": [G3]}
    (tmp_path / "bad.tsv").write_text("P1\n")
    with pytest.raises(ValueError):
        tables.read_profiles(spark, str(tmp_path / "bad.tsv"))


def test_motif_table(spark, tmp_path):
    head = "# made by us\nname\tdescription\tmotif_pattern\tstatus\n"
    (tmp_path / "m.tsv").write_text(head + "A\tfirst\tAA\tok\n# between\nB\t\tBB\tok\n")
    assert [(r.name, r.pattern) for r in tables.read_motifs(spark, str(tmp_path / "m.tsv")).orderBy("ord").collect()] == [("A", "AA"), ("B", "BB")]
    for bad in ("A\tx\tAA\tp\nA\tx\tAA\tp\n", "A\tx\t\tp\n"):
        (tmp_path / "bad.tsv").write_text(head + bad)
        with pytest.raises(ValueError):
            tables.read_motifs(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "cols.tsv").write_text("name\tstatus\nA\tp\n")
    with pytest.raises(ValueError):
        tables.read_motifs(spark, str(tmp_path / "cols.tsv"))


def test_members_hits_meta(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("member_id\tcluster_id\nP1\tc1\nP2\tc1\n")
    assert tables.read_members(spark, str(tmp_path / "c.tsv"), strict=True).count() == 2
    (tmp_path / "d.tsv").write_text("member_id\tcluster_id\nP1\tc1\nP1\tc2\n")
    with pytest.raises(ValueError):
        tables.read_members(spark, str(tmp_path / "d.tsv"))
    (tmp_path / "h.tsv").write_text("accession\tmotif_id\tmotif_present\tcount\nP1\tA\tyes\t0\nP2\tA\t0\t5\n# completed\ttrue\t\t\n")
    assert [tuple(r) for r in tables.read_hits(spark, str(tmp_path / "h.tsv")).collect()] == [("P1", "A")]
    (tmp_path / "n.tsv").write_text("accession\tmotif_id\tcount\nP1\tA\t0\nP2\tA\t2\n")
    assert [tuple(r) for r in tables.read_hits(spark, str(tmp_path / "n.tsv")).collect()] == [("P2", "A")]
    (tmp_path / "b.tsv").write_text("accession\tmotif_id\tcount\nP1\tA\tmany\n")
    with pytest.raises(ValueError):
        tables.read_hits(spark, str(tmp_path / "b.tsv"))
    (tmp_path / "m.tsv").write_text(f"cluster_id\tsim_ave\tsize\tcomposed_go\nc1\tNA\t3\t{G2},{G1};{G2}\n")
    r = tables.read_cluster_meta(spark, str(tmp_path / "m.tsv")).first()
    assert (r.composed_go, r.sim_ave, r["size"], r.description) == ([G2, G1], None, 3, "")


def test_missing_profiles(spark):
    m = spark.createDataFrame([("P1", "c"), ("P2", "c")], "entity string, cluster_id string")
    with pytest.raises(ValueError, match="P2"):
        tables.missing_profiles(m, m.limit(0).unionByName(m.where("entity = 'P1'")))


def test_configs():
    c = config.role_map("# top\nroles:\n  catalytic:\n    priority: 100  # high\n    anchors:\n      - GO:0000001 # x\n      - \"GO:2 # no\"\nrole_rules:\n  b:\n    keywords:\n      - 'it is'\n")
    assert c == {"roles": {"catalytic": {"priority": 100, "anchors": ["GO:0000001", "GO:2 # no"]}}, "role_rules": {"b": {"keywords": ["it is"]}}}
    for bad in ("other:\n", "  x:\n", "roles:\n    priority: 1\n", "roles:\n  a:\n      - x\n"):
        with pytest.raises(ValueError):
            config.role_map(bad)
    g = config.graph_config("neighbors: 4\nmin_similarity: 0.25 # low\nterm_cache_size_mb: 5\nstats_file: x.json\n")
    assert (g.neighbors, g.min_similarity, g.resolution) == (4, 0.25, 2.0)
    with pytest.raises(ValueError):
        config.graph_config("nonsense: 1\n")


class Reply:
    def __init__(self, data, ranged):
        self.data, self.headers = data, {"Content-Length": str(len(data)), **({"Accept-Ranges": "bytes"} if ranged else {})}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return self.data


def test_download(tmp_path, monkeypatch):
    body = bytes(range(256)) * 40
    calls = []

    def opener(request):
        calls.append(request.get_header("Range"))
        if request.get_header("Range"):
            a, b = request.get_header("Range")[6:].split("-")
            return Reply(body[int(a) : int(b) + 1], True)
        return Reply(body, True)

    monkeypatch.setattr(download, "LARGE", 1000)
    monkeypatch.setattr(download, "CHUNK", 3000)
    p = download.fetch("http://x/y", str(tmp_path / "y"), opener=opener)
    assert open(p, "rb").read() == body and "bytes=0-2999" in calls and not (tmp_path / "y.part").exists()
    assert download.setup({"y": "http://x/y", "z": "http://x/z"}, str(tmp_path), dry_run=True, opener=opener) == ["z"]
    assert download.setup({"z": "http://x/z"}, str(tmp_path), threads=1, opener=opener) == ["z"]
    short = lambda r: Reply(body[:5], False) if r.get_method() == "GET" else Reply(body, False)
    with pytest.raises(OSError):
        download.fetch("http://x/w", str(tmp_path / "w"), opener=short)
    assert not (tmp_path / "w").exists()


def test_fasta_index(spark, tmp_path):
    from seqgrove.sources import fasta_index

    rng = random.Random(2)
    rows = [(f"A{i}", "".join(rng.choices("ACDE", k=rng.randint(1, 400)))) for i in range(300)] + [("long", "K" * 300_000), ("none", ""), (None, "AC")]
    path = str(tmp_path / "fasta")
    fasta_index.write_fasta(spark.createDataFrame(rows, "accession string, sequence string").repartition(5), path, file_bytes=50_000)
    asked = [a for a, _ in rows] + ["other"]
    got = {r.accession: r.sequence for r in fasta_index.indexed_sequences(spark, path, spark.createDataFrame([(a,) for a in asked], "accession string")).collect()}
    assert got == {a: s or None for a, s in rows if a} | {"other": None, None: None}
    assert fasta_index.indexed_sequence(spark, path, "A7") == dict(rows)["A7"] and fasta_index.indexed_sequence(spark, path, "B7") is None
    text = sorted(r.query for r in flatfiles.read_fasta(spark, f"{path}/file=*").collect())
    assert text == sorted(a for a, s in rows if a and s)
    # a file that was changed since isn't read
    part = next((tmp_path / "fasta").glob("file=*/part-*"))
    part.with_name("." + part.name + ".crc").unlink(missing_ok=True)
    part.write_text(part.read_text() + ">X\nAC\n")
    with pytest.raises(ValueError):
        fasta_index.indexed_sequence(spark, path, "A7")
    empty = str(tmp_path / "empty")
    fasta_index.write_fasta(spark.createDataFrame([], "accession string, sequence string"), empty)
    assert fasta_index.indexed_sequence(spark, empty, "A7") is None
