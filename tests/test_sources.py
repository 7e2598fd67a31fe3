"""HTML to Markdown and EPUB containers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from skein.functions.providers import vectors_of
from skein.sources.html import book_texts, read_epub, to_markdown, write_assets

PNG = b"\x89PNG\r\n\x1a\n" + bytes(40)


def container(path, title="测试书", author="作者甲", extra=""):
    """Two documents, a navigation document, an image and a sound."""
    meta = (f"<dc:title>{title}</dc:title>" if title else "") + (f"<dc:creator>{author}</dc:creator>" if author else "")
    files = {
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf"/></rootfiles></container>',
        "EPUB/content.opf": f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{meta}</metadata><manifest>'
        '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c1" href="chapters/ch1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="chapters/ch2.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="p" href="images/pic.png" media-type="image/png"/><item id="a" href="audio/theme.mp3" media-type="audio/mpeg"/></manifest><spine><itemref idref="nav"/><itemref idref="c1"/><itemref idref="c2"/><itemref idref="c1"/></spine></package>',
        "EPUB/nav.xhtml": "<html><body><nav>contents</nav></body></html>",
        "EPUB/chapters/ch1.xhtml": '<html><head><title>第一章</title></head><body><h1>第一章 起风</h1><p>这里是<strong>正文</strong>。</p><img src="../images/pic.png" alt="插图" /><img src="../images/none.png"/><img src="http://x/y.png"/><audio src="../audio/theme.mp3" controls="controls"></audio></body></html>',
        "EPUB/chapters/ch2.xhtml": f"<html><body><h1>第二章 落雨</h1><p>第二段。</p>{extra}</body></html>",
        "EPUB/images/pic.png": PNG,
        "EPUB/audio/theme.mp3": b"ID3",
        "EPUB/unused.bin": b"x",
    }
    with zipfile.ZipFile(path, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)


@pytest.mark.parametrize("policy,assets", [("text-only", []), ("keep-images", ["images/pic.png"]), ("keep-all", ["audio/theme.mp3", "images/pic.png"])])
def test_epub_to_markdown(spark, tmp_path, policy, assets):
    container(tmp_path / "sample.epub")
    docs = read_epub(spark, f"file://{tmp_path}/sample.epub", policy)
    text = book_texts(docs, policy).first()
    assert text.text.startswith("# 测试书\n\n> 作者：作者甲\n\n# 第一章 起风\n\n这里是**正文**。") and text.text.endswith("# 第二章 落雨\n\n第二段。\n") and text.documents == 2
    assert ("![插图](sample_assets/EPUB/images/pic.png)" in text.text) == (policy != "text-only") and "none.png" not in text.text and "http:" not in text.text
    assert ('<audio controls src="sample_assets/EPUB/audio/theme.mp3"></audio>' in text.text) == (policy == "keep-all")
    assert write_assets(docs, f"file://{tmp_path}/out") == len(assets)
    assert sorted(str(p.relative_to(tmp_path / "out/sample_assets/EPUB")) for p in tmp_path.glob("out/**/*") if p.is_file()) == assets
    if assets:
        assert (tmp_path / "out/sample_assets/EPUB/images/pic.png").read_bytes() == PNG


def test_folder_of_containers(spark, tmp_path):
    """A partition a container; a book without metadata is named by its file; an empty folder has no rows."""
    (tmp_path / "books/deep").mkdir(parents=True)
    (tmp_path / "none").mkdir()
    container(tmp_path / "books/one.epub", "", "")
    container(tmp_path / "books/deep/two.EPUB", "Two")
    (tmp_path / "books/notes.txt").write_text("x")
    docs = read_epub(spark, str(tmp_path / "books"))
    assert docs.rdd.getNumPartitions() == 2 and docs.count() == 4
    assert sorted(r.text.split("\n\n第")[0].split("\n")[0] for r in book_texts(docs).collect()) == ["# Two", "# one"]
    assert read_epub(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="policy"):
        read_epub(spark, str(tmp_path / "books"), "some").count()


@pytest.mark.parametrize(
    "html,want",
    [
        ("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2<br>3</td></tr><tr><td>4</td></tr></table>", "| a | b\\|c |\n| --- | --- |\n| 1 | 2 3 |\n| 4 |  |"),
        ("<table><tr><td>1<td>2<tr><td>3<td>4</table>after", "| 1 | 2 |\n| --- | --- |\n| 3 | 4 |\n\nafter"),
        ("<pre>a\n    b  \n\n\n\nc</pre><p>x", "```\na\n    b  \n\n\n\nc\n```\n\nx"),
        ("<ol start=3><li>x<li>y<ul><li>in</ul></ol>", "3. x\n4. y\n  - in"),
        ("<ul>\n <li>a</li>\n <li>b</li>\n</ul>", "- a\n- b"),
        ("<p>a<svg><text>no</text><path d=''/></svg>b</p>", "ab"),
        ("<blockquote><p>q</p><p>r</p></blockquote>s", "> q\n>\n> r\n\ns"),
        ("<p><b>open<p>next", "**open\n\nnext\n\n**"),
        ("<b>x</b> <a href='u'>l</a><hr><code>c</code>", "**x** [l](u)\n\n---\n\n`c`"),
        ("<title>t</title><style>s</style>&lt;b&gt; &amp;", "<b> &"),
        (None, ""),
        ("<p>a\x02" + "0\x02 b", "a0 b"),
    ],
)
def test_markdown(html, want):
    assert to_markdown(html) == want


def test_markdown_media():
    page = '<img src="i.png"><video src="v.mp4"><source src="w.mp4"></video><object data="o.bin" type="a/b">alt</object><svg a="1"><g/>t</svg>'
    assert to_markdown(page, True) == '![image](i.png)\n\n<video controls src="v.mp4"></video>\n\n[Embedded object: a/b](o.bin)\n\nalt<svg a="1"><g/></g>t</svg>'
    assert to_markdown(page, "keep-images") == "![image](i.png)alt" and to_markdown(page) == "alt"


def test_flat_vectors():
    assert vectors_of({"embeddings": [1.0, 2.0]}) == [[1.0, 2.0]] and vectors_of({"embeddings": [[1.0], [2.0]]}) == [[1.0], [2.0]] and vectors_of({"embeddings": []}) == []


def test_ingest_of_containers(spark, tmp_path):
    from skein.__main__ import main
    from skein.plans import stored

    container(tmp_path / "b.epub", extra="<p>ｆｕｌｌ</p>")
    (tmp_path / "c.txt").write_text("第1章 始\n甲乙", encoding="utf-8")
    (tmp_path / "c.yaml").write_text("ingest: {nfkc: true, chapter_regex: '^(# )?第.+章.*$'}\n")
    main(["--config", str(tmp_path / "c.yaml"), "--data-dir", f"file://{tmp_path}/data", "ingest", f"file://{tmp_path}/b.epub", f"file://{tmp_path}/c.txt"])
    got = stored.library(spark, f"file://{tmp_path}/data").read("chapters")
    assert sorted(r.title for r in got.collect()) == ["# 第一章 起风", "# 第二章 落雨", "序章", "第1章 始"]
    assert got.where(F.contains("body", F.lit("full"))).count() == 1
