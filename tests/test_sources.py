import gzip

from stemma.sources import fasta, genbank, newick, structure, synthetic
from stemma.streaming import composition as streaming

RECORD = """LOCUS       X1 40 bp
DEFINITION  a test.
ACCESSION   X1 other
FEATURES             Location/Qualifiers
     source          1..40
     CDS             complement(join(1..3,
                     7..9))
                     /locus_tag="L1"
                     /product="first
                     product"
                     /product="second"
                     /pseudo
                     /translation="MK
                     T"
     rRNA            10..12
                     /gene="r"
ORIGIN
        1 aaacccgggt ttaaacccgg gtttaaaccc gggtttaaac
//
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x one\nacg\nT\n>y\n\n>x two\nGG\n")
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">z\nAC\n")
    got = {(r.id, r.header, r.seq) for r in fasta.read(spark, str(tmp_path)).collect()}
    assert got == {("x", "x one", "ACGT"), ("x", "x two", "GG"), ("y", "y", ""), ("z", "z", "AC")}
    fasta.write(fasta.read(spark, str(tmp_path)), str(tmp_path / "out"))
    assert {(r.id, r.seq) for r in fasta.read(spark, str(tmp_path / "out")).collect()} == {(i, s) for i, _, s in got}


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(RECORD * 2)
    rows = genbank.read(spark, str(tmp_path / "a.gb")).collect()
    assert len(rows) == 4
    cds, rrna = (next(r for r in rows if r.type == t) for t in ("CDS", "rRNA"))
    assert (cds.accession, cds.locus_tag, cds.product, cds.pseudo, cds.aa) == ("X1", "L1", "first product", True, "MKT")
    assert (cds.start, cds.end, cds.strand, cds.nt) == (0, 9, -1, "CCCTTT")
    assert (rrna.start, rrna.end, rrna.strand, rrna.nt, rrna.gene_name) == (9, 12, 1, "TTT", "r")


def test_structure(spark, tmp_path):
    line = "ATOM      1  CA  ALA A   7      11.104   6.134  -6.504  1.00 12.50           C  "
    (tmp_path / "a.pdb").write_text(f"HEADER\n{line}\nTER\n")
    atoms = structure.read(spark, str(tmp_path / "a.pdb"), "A")
    a = atoms.first()
    assert (a.serial, a.atom, a.residue, a.number, a.x, a.z, a.b) == (1, "CA", "ALA", 7, 11.104, -6.504, 12.5)
    new = structure.with_factors(atoms, spark.createDataFrame([(7, 0.5)], "number int, score double")).first().line
    assert new == line[:60] + " 50.00" + line[66:]


def test_newick(spark):
    rows = newick.nodes("((A:1,'B b':2)95:0.02:0.25,C,(D,E)x);")
    assert rows[1] == (1, 0, "", 95.0, 0.25) and [r[2] for r in rows] == ["", "", "A", "B b", "C", "x", "D", "E"]
    trees = spark.createDataFrame([(1, "(A,B);"), (2, None)], "tree int, value string")
    assert newick.read(trees).filter("tree = 1").count() == 3


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aaa ccc", "en", "s"), (2, "ggg", "de", "s"), (3, "ccc", "en", "s")], "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = streaming.running(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.species, r.n) for r in spark.table("running").collect()} == {("en", 2), ("de", 1)}


def test_csv_and_log(spark, tmp_path):
    from stemma.sources import tabular

    schema = "gene string, n bigint, x double"
    rows = [("a", 1, 0.1 + 0.2), ("b, c", None, 1e-17), (None, 3, None)]
    df = spark.createDataFrame(rows, schema)
    tabular.write_csv(df, str(tmp_path / "t"))
    back = tabular.read_csv(spark, str(tmp_path / "t"), schema)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    log = str(tmp_path / "log")
    assert tabular.read_log(spark, log, schema).collect() == []
    tabular.write_log(df, log)
    tabular.write_log(df.limit(1), log)
    assert tabular.read_log(spark, log, schema).count() == 4


def test_genbank_metadata_and_slices(spark, tmp_path):
    (tmp_path / "a.gb").write_text(RECORD + RECORD.replace("X1", "X2").replace("a test.", "two\n            lines."))
    path = str(tmp_path / "a.gb")
    got = {r.accession: (r.title, r.length, r.gc) for r in genbank.metadata(spark, path).collect()}
    assert got == {"X1": ("a test", 40, 0.475), "X2": ("two lines", 40, 0.475)}  # 19 of 40
    wanted = spark.createDataFrame([("X1", "a gene with a long name", 3, 12), ("X1", "b", 0, 40), ("X9", "b", 0, 3), ("X2", "b", None, 3)], "accession string, gene string, start bigint, end bigint")
    genbank.write_slices(genbank.slices(spark, path, wanted), str(tmp_path / "out"))
    back = {r.accession: r for r in genbank.metadata(spark, str(tmp_path / "out")).collect()}
    assert {k: r.length for k, r in back.items()} == {"X1:4-12": 9, "X1:1-40": 40}
    text = genbank.cut_out("a gene with a long name", "X1", 3, 12, "AAACCCGGGTTTAA")
    assert text.splitlines()[0].split()[1:6] == ["a", "gene", "with", "a", "lo"] and "cccgggttt" in text.replace(" ", "")


def test_coding_and_ribosomal(spark):
    rows = [("CDS", "M", False, "30S ribosomal protein S2"), ("CDS", "", False, "50S ribosomal protein L1"), ("CDS", "M", True, "x"), ("rRNA", "M", False, "x"), ("CDS", "M", False, "a 30S ribosomal protein")]
    df = spark.createDataFrame(rows, "type string, aa string, pseudo boolean, product string")
    assert genbank.coding(df).count() == 2
    assert [r.product for r in genbank.ribosomal(df).collect()] == ["30S ribosomal protein S2"]


def test_headed_fasta_and_newick_sink(spark, tmp_path):
    df = spark.createDataFrame([("g1", "rpoB", "L1", "ACG"), ("g2", "rpoB", None, "A")], "label string, gene string, locus_tag string, seq string")
    rows = df.select(fasta.headed(df.label, gene=df.gene, locus_tag=df.locus_tag).alias("id"), "seq")
    fasta.write(rows, str(tmp_path / "f"), compression="gzip")
    assert {(r.id, r.header) for r in fasta.read(spark, str(tmp_path / "f")).collect()} == {("g1", "g1 gene=rpoB locus_tag=L1"), ("g2", "g2 gene=rpoB")}
    trees = spark.createDataFrame([("a", "(A:1.00000,B:2.00000);"), ("b", "(C,D)99.00;")], "gene string, value string")
    newick.write(trees, str(tmp_path / "t"), by="gene")
    assert sorted(map(tuple, spark.read.text(str(tmp_path / "t")).select("gene", "value").collect())) == sorted(map(tuple, trees.collect()))


def test_panel_is_made_in_parallel_with_one_digest_a_codon(spark):
    """However few parts the keys are read in; keys that are null or many make the same panel."""
    rows = [(i, g, s) for i in range(1, 40) for g in ("a", None) for s in ("en", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string").coalesce(1)
    got = synthetic.derived_panel(docs, 20)
    assert got.rdd.getNumPartitions() > 4 and got.count() == len(rows)
    made = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "__codons" in x and "md5(" in x)
    assert made.count("md5(") == made.count("array_join(")
