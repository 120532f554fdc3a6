"""Block gzip: byte ranges against plain text, the block index, torn files."""

import gzip
import random
import zlib

import pyarrow as pa
import pytest

from varloom.plans import jobs
from varloom.sources import blocks, text
from varloom.sources.blocks import END_MARKER


def block_file(path, content: bytes, block=700, marker=True):
    parts = [blocks._compress(content[i : i + block]) for i in range(0, len(content), block)]
    data = b"".join(parts) + (END_MARKER if marker else b"")
    path.write_bytes(data)
    return str(path), [len(p) for p in parts]


def vcf_text(n=3_000, seed=1):
    rng = random.Random(seed)
    head = "##fileformat=VCFv4.1\n##long=" + "x" * 3_000 + "\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    rows = []
    for i in range(n):
        ident = "." if i % 50 == 0 else str(i)
        info = f"MC=SO:1|missense_variant;é={rng.random()}" + ("y" * 5_000 if i % 997 == 0 else "")
        rows.append(f"1\t{i}\t{ident}\tA\tG\t.\t.\t{info}" + ("\tGT\t0/1" if i % 7 == 0 else "") + "\n")
    rows.insert(5, "\n")
    rows.insert(9, "1\t2\tshort\n")
    return (head + "".join(rows)).encode()


def read_all(path, step):
    """The lines that the ranges of ``step`` bytes own, in order."""
    size = blocks.open_file(path)[1]
    out = []
    for _, start, end in blocks.cut_ranges([(path, size)], 1, step):
        stream, _ = blocks.open_file(path)
        out += [line for piece in blocks.owned_text(blocks.Blocks(path, stream, size), start, end) for line in piece.splitlines()]
    return out


@pytest.mark.parametrize("step", [1, 40, 333, 4_000, 10**9])
def test_every_line_once_whatever_the_cuts(tmp_path, step):
    content = vcf_text(60 if step == 1 else 700)
    path, _ = block_file(tmp_path / "a.vcf.gz", content, block=rng_block(step))
    assert read_all(path, step) == content.splitlines()
    assert gzip.decompress((tmp_path / "a.vcf.gz").read_bytes()) == content  # and any gzip reader reads the file


def rng_block(step):
    return 97 if step < 100 else 700


@pytest.mark.parametrize("content", [b"", b"\n", b"one line without end", b"a\r\nb\r\nc", b"a\rb\rc\n", b"\n\n\nx\n\n", b"z" * 9_000])
@pytest.mark.parametrize("step", [1, 30, 10**6])
def test_odd_texts(tmp_path, content, step):
    path, _ = block_file(tmp_path / "a.gz", content, block=7 if len(content) < 100 else 1_000)
    assert read_all(path, step) == content.splitlines()


def test_a_batch_boundary_keeps_lines_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BATCH_TEXT", 1_000)
    content = vcf_text(400)
    path, _ = block_file(tmp_path / "a.gz", content, block=64)
    assert read_all(path, 5_000) == content.splitlines()


def test_magic_bytes_inside_a_block_are_not_a_block(tmp_path):
    """Stored (incompressible) blocks that hold whole headers as their text."""
    rng = random.Random(2)
    noise = b"".join(rng.randbytes(20) .replace(b"\n", b" ") + END_MARKER[:18] + b"\n" for _ in range(2_000))
    squeeze = []
    for i in range(0, len(noise), 5_000):
        body = noise[i : i + 5_000]
        store = zlib.compressobj(0, zlib.DEFLATED, -15)
        raw = store.compress(body) + store.flush()
        squeeze.append(END_MARKER[:16] + (len(raw) + 25).to_bytes(2, "little") + raw
                       + zlib.crc32(body).to_bytes(4, "little") + len(body).to_bytes(4, "little"))
    (tmp_path / "a.gz").write_bytes(b"".join(squeeze) + END_MARKER)
    assert read_all(str(tmp_path / "a.gz"), 3_000) == noise.splitlines()


def test_vcf_blocks_equal_plain_text_over_many_tasks(spark, tmp_path):
    content = vcf_text()
    (tmp_path / "plain.vcf").write_bytes(content)
    path, parts = block_file(tmp_path / "a.vcf.gz", content)
    plain = sorted(map(repr, text.read_vcf(spark, str(tmp_path / "plain.vcf")).collect()))
    for step in (1_000, 20_000, None):
        df = text.read_vcf_blocks(spark, path, step)
        if step:
            assert df.rdd.getNumPartitions() == -(-(tmp_path / "a.vcf.gz").stat().st_size // step) > 1
        assert sorted(map(repr, df.collect())) == plain
    assert sorted(map(repr, text.read_vcf(spark, path).collect())) == plain  # found by its content
    index = blocks.block_index(spark, [path], 3_000).orderBy("offset").collect()
    assert [r["length"] for r in index] == [*parts, len(END_MARKER)]
    assert sum(r["length"] for r in index) == (tmp_path / "a.vcf.gz").stat().st_size
    assert sum(r["text_length"] for r in index) == len(content)


def test_a_folder_of_all_kinds(spark, tmp_path):
    """Plain, gzip and block gzip (also under an undecoded name) side by side."""
    kinds = tmp_path / "in put"
    kinds.mkdir()
    contents = [vcf_text(50, seed) for seed in range(4)]
    (kinds / "a.vcf").write_bytes(contents[0])
    (kinds / "b.vcf.gz").write_bytes(gzip.compress(contents[1]))
    block_file(kinds / "c.vcf.gz", contents[2])
    block_file(kinds / "d.vcf.bgz", contents[3])
    both = tmp_path / "plain"
    both.mkdir()
    for i, c in enumerate(contents):
        (both / f"{i}.vcf").write_bytes(c)
    want = sorted(map(repr, text.read_vcf(spark, str(both)).collect()))
    assert sorted(map(repr, text.read_vcf(spark, str(kinds)).collect())) == want


def test_tsv_blocks_bind_by_header(spark, tmp_path):
    rows = [(f"n{i}", str(i), "" if i % 3 else "x") for i in range(500)]
    one = "Name\tVariation.ID\tz\n" + "".join("\t".join(r) + "\n" for r in rows[:250])
    two = "z\tName\tVariation.ID\n" + "".join("\t".join((r[2], r[0], r[1])) + "\n" for r in rows[250:])
    block_file(tmp_path / "a.tsv.gz", one.encode())
    block_file(tmp_path / "b.tsv.bgz", two.encode())
    got = text.read_tsv(spark, [str(tmp_path / "a.tsv.gz"), str(tmp_path / "b.tsv.bgz")], ["Variation.ID", "Name", "z"])
    assert sorted(tuple(r) for r in got.na.fill("").collect()) == sorted((b, a, c) for a, b, c in rows)


@pytest.mark.parametrize("harm", ["middle cut out", "cut in a block", "no end marker", "checksum", "length", "noise"])
def test_torn_files_raise(spark, tmp_path, harm):
    path, parts = block_file(tmp_path / "a.vcf.gz", vcf_text(800))
    data = bytearray((tmp_path / "a.vcf.gz").read_bytes())
    if harm == "middle cut out":
        del data[sum(parts[:20]) + 30 : sum(parts[:20]) + 90]
    elif harm == "cut in a block":
        del data[-200:]
    elif harm == "no end marker":
        del data[-len(END_MARKER) :]
    elif harm == "checksum":
        data[sum(parts[:31]) - 8] ^= 1
    elif harm == "length":
        data[sum(parts[:31]) + 16] ^= 4
    else:
        at = sum(parts[:12]) + 25
        data[at : at + 100] = bytes(100)
    (tmp_path / "a.vcf.gz").write_bytes(bytes(data))
    with pytest.raises(Exception, match="torn|no block within"):
        text.read_vcf_blocks(spark, path, 2_000).count()


def test_other_files_are_not_blocks(tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"plain gzip"))
    (tmp_path / "b.txt").write_bytes(b"text")
    (tmp_path / "c.gz").write_bytes(b"")
    for name in ("a.gz", "b.txt", "c.gz", "missing"):
        assert not blocks.readable_blocks(str(tmp_path / name))
    assert not blocks.readable_blocks("nosuchscheme://x/y.gz")
    (tmp_path / "d").write_bytes(END_MARKER)
    assert blocks.readable_blocks(str(tmp_path / "d"))


def test_written_blocks_read_back(spark, tmp_path):
    """Spark's text writer commits block-gzip files that every gzip reader accepts, end marker included."""
    lines = [f"line {i} é " + "w" * (i % 300) for i in range(4_000)] + ["", "last"]
    df = spark.createDataFrame([(v,) for v in lines], "value string").repartition(3)
    out = str(tmp_path / "out")
    blocks.write_block_lines(df, out)
    files = sorted((tmp_path / "out").glob("part-*"))
    plain = []
    for f in files:
        data = f.read_bytes()
        assert not data or data.endswith(END_MARKER)
        plain += gzip.decompress(data).decode().splitlines()
    assert sorted(plain) == sorted(lines)
    back = blocks.block_lines(spark, [out], 4_000).select("value")
    assert sorted(r[0] for r in back.collect()) == sorted(lines)


def test_blocks_of_noise_are_stored():
    noise = random.Random(1).randbytes(blocks.BLOCK_TEXT)
    member = blocks._compress(noise)
    assert len(member) <= blocks.MAX_BLOCK and gzip.decompress(member) == noise
    batch = pa.record_batch([pa.array(["a" * 70_000, None, "b"])], names=["v"])
    out = [v.as_py() for b in blocks.compress_lines([batch]) for v in b.column(0)]
    assert len(out) == 2 and gzip.decompress(b"".join(out)) == b"a" * 70_000 + b"\n\nb\n"


def test_ranges_follow_size_and_tasks():
    files = [("a", 100 << 20), ("b", 5), ("c", 0)]
    cuts = blocks.cut_ranges(files, 2)
    assert all(e - s <= blocks.RANGE_BYTES for _, s, e in cuts)
    for name, size in files:
        own = [(s, e) for p, s, e in cuts if p == name]
        assert sum(e - s for s, e in own) == size and [s for s, _ in own] == sorted(s for s, _ in own)
    assert len(blocks.cut_ranges([("a", 10 * blocks.MAX_BLOCK)], 100)) == 10


def test_variant_summary_job_reads_blocks(spark, tmp_path):
    from varloom.constants import VARIANT_FILTER_COLUMNS, VARIANT_SUMMARY_COLUMNS

    names = [*VARIANT_SUMMARY_COLUMNS, *VARIANT_FILTER_COLUMNS]
    body = "\t".join(names) + "\n" + "".join("\t".join(f"{n}{i}" for n in names) + "\n" for i in range(300))
    path, _ = block_file(tmp_path / "vs.txt.gz", body.encode())
    assert jobs.read_variant_summary(spark, path).count() == 300
