import pytest

from doclake.operators.quality import crawl_summary
from doclake.sources.files import file_report, read_directory, read_files
from doclake.sources.pages import pages_to_markdown


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("site")
    files = {
        "a.md": b"# T\nHome\nbody text\n",
        "My  File<1>.TXT.txt": b"plain\r\nHome\n",
        "latin.rst": "café".encode("latin-1"),
        "skip.log": b"x",
        "code.pyc": b"x",
        "node_modules/lib/x.js": b"let x = 1",
        "sub/b.Markdown": b"b text here\nok\n",
        "sub/c.py": "print('é')".encode(),
        "dist": b"a file of that name",
        "pkg/__init__.py": b"version = 1\r\n",
        ".github/note.md": b"hidden note\n\nHome\n",
        ".env": b"x",
        "pages/[slug].md": b"slug here",
        "pages/50% a.txt": b"half",
    }
    for name, data in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(base)


def test_contents(spark, root):
    got = {r["url"].rsplit("/", 1)[1]: r for r in read_files(spark, f"{root}/*.*").collect()}
    assert got["a.md"]["content"] == "# T\nbody text"
    assert got["a.md"]["file_size"] == 19 and got["a.md"]["content_length"] == 13
    assert got["latin.rst"]["content"] == "café"
    odd = got["My  File<1>.TXT.txt"]
    assert (odd["title"], odd["file_extension"], odd["content"]) == ("My_File_1_.TXT", ".txt", "plain\nHome\n")
    assert got["a.md"]["url"] == f"file://{root}/a.md"


def names(df, root):
    return {r["url"].removeprefix(f"file://{root}/") for r in df.select("url").collect()}


def test_globs(spark, root):
    found = names(read_directory(spark, root), root)
    hidden = {"pkg/__init__.py", ".github/note.md"}
    odd = {"pages/[slug].md", "pages/50% a.txt"}
    assert found == {"a.md", "My  File<1>.TXT.txt", "latin.rst", "node_modules/lib/x.js", "sub/c.py"} | hidden | odd
    assert names(read_directory(spark, root, prune_dirs=True), root) == found - {"node_modules/lib/x.js"}
    assert names(read_directory(spark, root, max_files=100), root) == found
    got = {r["title"]: r for r in read_directory(spark, root).collect()}
    assert (got["init"]["content"], got["init"]["file_size"]) == ("version = 1\n", 13)
    assert got["note"]["content"] == "hidden note"
    assert names(read_directory(spark, root, max_files=2), root) == {".github/note.md", "My  File<1>.TXT.txt"}
    assert names(read_directory(spark, root, ["*.py"], ["sub/*"]), root) == {"pkg/__init__.py"}
    assert names(read_directory(spark, root, ["?.[!p]*"], []), root) == {"a.md", "sub/b.Markdown", "node_modules/lib/x.js"}
    assert ".env" in names(read_directory(spark, root, [".e*"], []), root)
    assert read_directory(spark, root, ["*.none"]).count() == 0


def test_report(spark):
    rows = [("a", "processed"), ("b", "failed"), ("c", "skipped"), ("d", "processed")]
    r = file_report(spark.createDataFrame(rows, "file string, status string")).first()
    assert (r["processed_files"], r["failed_files"], r["skipped_files"], r["total_files"]) == (2, 2, 1, 4)


def test_pages(spark):
    html = (
        "<html><head><title> A &amp; B </title><style>x</style></head><body><nav>menu</nav><h1>Head</h1><p>Some <a href='/u'>"
        "link</a> &lt;t&gt;</p><ul><li>one</li><li>two<ol><li>in</li></ol></li></ul><pre><code class='c'>a = 1\n  b()</code></pre>"
        "<p>use <code>f(x)</code></p><script>bad()</script><footer>foot</footer></body></html>"
    )
    rows = [("http://x/my-page", html), ("http://x/my-page", "<p>no title"), ("http://x/n", None)]
    got = pages_to_markdown(spark.createDataFrame(rows, "url string, html string")).collect()
    assert got[0]["title"] == "A & B" and got[1]["title"] == "My Page"
    text = got[0]["markdown"]
    assert text.startswith("# Head\n\nSome [link](/u) <t>\n\n* one\n* two") and "```\na = 1\n  b()\n```" in text
    assert "`f(x)`" in text and not any(w in text for w in ("menu", "bad", "foot"))
    assert got[1]["markdown"] == "no title" and got[2]["markdown"] is None


def test_summary_of_nothing(spark):
    found = spark.createDataFrame([], "url string")
    done = spark.createDataFrame([], "length int, relevance_score double")
    r = crawl_summary(found, done, scored=True).first()
    assert (r["pages_found"], r["pages_extracted"], r["average_page_size"], r["average_relevance_score"]) == (0, 0, 0, 1.0)


def test_read_files_takes_folders_patterns_and_hidden_names(spark, tmp_path):
    from doclake.sources.files import read_files

    for name in ("a.md", "_b.md", ".c.md", "d.txt", "sub/e.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)

    def found(*paths):
        return sorted(r["content"] for r in read_files(spark, [f"{tmp_path}{p}" for p in paths]).collect())

    assert found("") == [".c.md", "_b.md", "a.md", "d.txt"]
    assert found("/*.md") == [".c.md", "_b.md", "a.md"]
    assert found("/{a,d}.*") == ["a.md", "d.txt"] and found("/[!a]*.md", "/sub") == [".c.md", "_b.md", "sub/e.md"]
    assert found("/a.md", "/a.md", "/s?b/*") == ["a.md", "sub/e.md"]
