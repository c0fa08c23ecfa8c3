import hashlib
import gzip
import random

import pytest
from pyspark.sql import functions as F

from callytics.llm import main_text, warc
from callytics.llm.common import new_folder
from callytics.llm.html_tree import match

LONG = "<p>" + "long payload " * 20 + "</p>"
PAGES = [
    (5, "http://a.example/1", LONG),
    (3, "http://a.example/2", LONG),
    (9, None, LONG),
    (4, "http://b.example/\r\nWARC-Type: evil", LONG + "é😀\r\n\r\nWARC/1.1"),
    (6, "http://c.example", None),
    (7, "http://c.example", ""),
    (8, "", "short"),
    (2, "x", "short"),
    (None, "n", LONG),
    (None, "n", "only without id " * 20),
    (None, "m", "only without id " * 20),
    (11, "r", "repeated row " * 30),
    (11, "r", "repeated row " * 30),
    (12, "big", "".join(random.Random(1).choices("abcdefghijklmnop<> \n", k=300_000))),
]


@pytest.fixture
def pages(spark):
    return lambda rows=PAGES: spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture
def archive(spark, pages):
    folder = new_folder(spark, "warc")
    warc.write_pages(pages().withColumn("digest", F.lit(1)).withColumn("payload", F.lit("clash")), folder)
    return folder


def wanted():
    least = {}
    for p, _, h in PAGES:
        if p is not None and len((h or "").encode()) >= 100:
            least[h] = min(p, least.get(h, p))
    rows = []
    for p, _, h in PAGES:
        data = (h or "").encode()
        first = least.get(h) if len(data) >= 100 else None
        revisit = first is not None and p != first
        rows.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(rows, key=repr)


def test_round_trip(spark, archive):
    records = warc.read_records(spark, archive)
    assert sorted((tuple(r) for r in warc.page_records(records).collect()), key=repr) == wanted()
    texts = {r["payload"].decode() for r in records.filter("record_type = 'response'").collect()}
    assert texts == {h or "" for _, _, h in PAGES}
    evil = records.filter("record_id = 'urn:page:4'").first()
    assert evil["target_uri"] == "http://b.example/%0D%0AWARC-Type:%20evil" and evil["record_type"] == "response"


def test_heads_only_and_pushed_predicates(spark, archive, capsys):
    heads = warc.read_records(spark, archive, payload=False)
    assert heads.filter("payload is not null").count() == 0 and heads.count() == len(PAGES)
    some = heads.filter("record_type = 'revisit' and payload_length >= 100 and record_id in ('urn:page:5', 'urn:page:9', 'urn:page:6')")
    assert sorted(r["record_id"] for r in some.collect()) == ["urn:page:5", "urn:page:9"]
    assert heads.filter("target_uri is null").count() == 1
    assert heads.filter("target_uri like 'http://c%'").count() == 2
    reader = warc.WarcReader({"path": archive})
    from pyspark.sql.datasource import EqualTo, Not

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), EqualTo(("payload",), b""), Not(EqualTo(("date",), "x"))]))
    assert len(left) == 2 and len(reader.passes) == 1


def test_split_files_and_plain_archives(spark, archive):
    whole = sorted(r["record_id"] for r in warc.read_records(spark, archive).collect())
    spark_reader = spark.read.format("warc").option("splitBytes", "300").load(archive)
    assert sorted(r["record_id"] for r in spark_reader.collect()) == whole
    # The same records as a foreign archive: unpacked, and packed again as one stream, without index or list.
    from pyarrow.fs import FileSystem

    files, root = FileSystem.from_uri(archive)
    data = b""
    for part in warc.WarcReader({"path": archive}).partitions():
        if part.part == 0:
            with files.open_input_stream(f"{root}/{part.name}", compression=None) as f:
                data += gzip.decompress(f.read())
    for name, content in (("plain.warc", data), ("one.warc.gz", gzip.compress(data))):
        folder = new_folder(spark, "foreign")
        files.create_dir(files.normalize_path(root.rsplit("/", 1)[0] + "/" + folder.rsplit("/", 1)[1]))
        with files.open_output_stream(root.rsplit("/", 1)[0] + "/" + folder.rsplit("/", 1)[1] + "/" + name, compression=None) as f:
            f.write(content)
        records = warc.read_records(spark, folder)
        assert sorted((tuple(r) for r in warc.page_records(records).collect()), key=repr) == wanted()
        assert warc.read_records(spark, folder, payload=False).filter("record_type = 'revisit'").count() == sum(r[3] == "revisit" for r in wanted())


@pytest.mark.parametrize("length", [b"Content-Length: many", b"Content-Length: -5", b"X: y"])
def test_malformed_lengths_and_cut_off_records(spark, tmp_path, length):
    from pathlib import Path

    def record(number, head=None, body=b"<p>text</p>"):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        head = head or f"Content-Length: {len(block)}".encode()
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\n%s\r\n\r\n%s\r\n\r\n" % (number, head, block)

    data = record(1) + record(2, length) + record(3, length, b"") + record(4) + record(5)[:-12]
    for name, content in (("a.warc", data), ("b.warc.gz", gzip.compress(data))):
        folder = tmp_path / name
        folder.mkdir()
        Path(folder / name).write_bytes(content)
        rows = warc.read_records(spark, str(folder)).collect()
        assert sorted(r["record_id"].strip("<>")[-1] for r in rows) == ["1", "4"]


def test_uncommitted_archives_are_not_read(spark, archive):
    before = warc.read_records(spark, archive, payload=False).count()
    writer = warc.WarcWriter(archive, "2024-01-01T00:00:00Z", [])
    import pyarrow as pa

    writer.write(iter([pa.RecordBatch.from_pylist([{"record_id": "urn:x", "record_type": "response", "payload": b"x"}])]))
    assert warc.read_records(spark, archive, payload=False).count() == before


def test_no_pages(spark, pages):
    folder = new_folder(spark, "warc")
    warc.write_pages(pages([]), folder)
    assert warc.read_records(spark, folder).count() == 0


CASES = [
    ("<body><nav><p>menu</nav><article><h1>T &amp; x</h1><p>One<b> two<br>three<p>Four <a href=x>five</a></article><footer>f</footer>", "T & x\nOne two three\nFour five"),
    ("<article><p>a</p><div class='ad'>buy</div><aside>s</aside><form>f<input></form><p>b</p></article>", "a\nb"),
    ("<article><p>x &lt;b&gt; &#233;&nbsp; y\n z</p><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "x <b> é y z\n1\n2\n3\n4"),
    ("<article><p>kept</p></article><section class='comments'><article class='comment'><p>a longer comment of a reader</p></article></section>", "kept"),
    ("<article><p>in</p><div id='comments'><p>out</p></div><div class='cookie-notice'>out</div><p hidden>out</p></article>", "in"),
    ("<main><header><h1>Head</h1></header><p>text</p></main><div class=sidebar>s</div>", "Head\ntext"),
    ("<div class='page sidebar'><article><p>inside</p></article></div>", "inside"),
    ("<body><div class='header'>h</div><div><p>no article</p><ul><li><a href=1>m1</a><li><a href=2>m2</a></ul></div>", "no article"),
    ("<article><script>if (a<b) {'</p>'}</script><style>p{}</style><!-- c --><p>s</p><script>open", "s"),
    ("<article>a < b & c &unknown; <p>x", "a < b & c &unknown;\nx"),
    ("", ""),
    (None, ""),
    ("plain text", "plain text"),
    ("<p>" * 3_000 + "deep", "deep"),
    ("<div>" * 3_000 + "deep", "deep"),
    ("<article><p title='unclosed>x</p><p>y</p></article>", "x\ny"),
    ("<main><p>A long paragraph of the page itself, which is its text.</p><article><p>teaser</p></article></main>", "A long paragraph of the page itself, which is its text.\nteaser"),
    ("<main><article><p>Part one</p></article><article><p>Part two, longer</p></article></main>", "Part one\nPart two, longer"),
    ("<body><nav>menu</nav><form><div><p>All of the page is in a form.</p></div></form></body>", "All of the page is in a form."),
    ("<div class='content no-sidebar'><p>The text.</p></div><div class='sidebar'><p>aside</p></div>", "The text."),
    ("<article><div class='share'><p>The whole article stands in here.</p></div><p>End</p></article>", "The whole article stands in here.\nEnd"),
    ("<div><p>Plain words.</p><p><a href=x>A whole paragraph that is a single link.</a></p><p><a href=y>Home</a></p></div>", "Plain words.\nA whole paragraph that is a single link."),
    ("<article><p>text of it</p></article><section class='related'><article><p>another story, told at greater length</p></article></section>", "text of it"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_tags(html, text):
    assert main_text.extract(html) == text


def test_matching_keeps_order_and_counts_nodes():
    a = ["d", [["p", 0, 1], ["p", 1, 2], ["s", [["p", 2, 3]]]]]
    b = ["d", [["p", 0, 2], ["s", [["q", 1, 9], ["p", 2, 3]]]]]
    assert sorted(match(a, b)) == [(1, 0, True), (2, 2, True)]
    assert match(a, ["x", []]) == []
    assert match(["p", 0, 5], ["p", 0, 5]) == [(0, 0, True)]


def test_blocks_of_the_template_are_left_out(spark, pages):
    rng = random.Random(1)
    words = lambda: " ".join("".join(rng.choices("abcdefgh ", k=60)).split())
    rows, want = [], {}
    for i in range(12):
        body = [words() for _ in range(rng.randrange(2, 6))]
        rows.append((i, f"http://one.example/{i}", "<article><p>Read our letter</p>" + "".join(f"<p>{b}</p>" for b in body) + "<p>All of us</p></article>"))
        want[i] = "\n".join(body)
    same = [words() for _ in range(6)]
    for i in range(20, 40):  # near copies of one article: nothing of it is template
        body = same[:]
        body[rng.randrange(6)] = words()
        rows.append((i, "http://two.example", "<article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>"))
        want[i] = "\n".join(body)
    for i in range(50, 60):  # exact copies
        rows.append((i, "http://three.example", "<article><p>one</p><p>and two</p></article>"))
        want[i] = "one\nand two"
    for i in range(60, 70):  # no article named: a repeated block is template, the varying one is content
        rows.append((i, "http://four.example", f"<div><p>Our motto</p></div><div><p>{i} {words()}</p><p>{words()}</p></div>"))
        want[i] = "\n".join(p.split("</p>")[0] for p in rows[-1][2].split("<p>")[2:])
    boiler = [f"Line {n} of the house" for n in range(10)]
    for i in range(100, 112):  # ten equal untagged lines around two of the page's own
        own = [words(), words()]
        rows.append((i, "http://five.example/x", "<div>" + "".join(f"<div>{b}</div>" for b in boiler[:6] + own + boiler[6:]) + "</div>"))
        want[i] = "\n".join(own)
    for i in range(120, 160):  # two layouts on one host, each with lines of its own
        own = [words() for _ in range(rng.randrange(2, 5))]
        box, line = (("news", "All news of the day"), ("shop", "Free delivery on every order"))[i % 2]
        rows.append((i, "http://six.example/", f"<div class='{box}'><div>{line}</div>" + "".join(f"<p>{o}</p>" for o in own) + "</div>"))
        want[i] = "\n".join(own)
    rows += [(80, None, "<p>no url</p>"), (81, "http://one.example/", None), (None, "http://one.example/x", "<p>no id</p>")]
    want |= {80: "no url", 81: "", None: "no id"}
    rows.append(rows[0])
    got = main_text.main_texts(pages(rows).withColumn("text", F.lit("clash")).withColumn("k", F.lit(0))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])
    assert main_text.main_texts(pages([])).count() == 0
