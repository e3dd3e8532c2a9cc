import pytest

from tessella.llm import markup as mk

CASES = [
    ("<h2>标题</h2><p>正<b>文</b>。</p>", "标题\n正文。", ["html"]),
    ("<ul><li>一<li>二</ul><script>var t=1;</script>", "- 一\n- 二", ["html"]),
    ("&lt;p&gt;温升&amp;gt;60K&lt;/p&gt;", "温升>60K", ["html"]),
    ("<table><tr><td>项目<td>本期</tr><tr><td>**营收**<td>1</tr></table>", "项目 | 本期\n营收 | 1", ["html", "markdown"]),
    ("<pre><code>for x in rows:\n    keep(x &gt; 1)</code></pre>", "for x in rows:\n    keep(x > 1)", ["html"]),
    ("# 标题 #\n\n* 一\n+ 二\n\n> 引用[链](https://a.example/x)", "标题\n\n- 一\n- 二\n\n引用链", ["markdown"]),
    ("标题\n======\n\n文`码`字__粗__5", "标题\n\n文码字粗5", ["markdown"]),
    ("__研发投入__CNY 1 mn，接__口变量__a_b_c", "研发投入CNY 1 mn，接口变量a_b_c", ["markdown"]),
    ("```\nlimit=40\n# no heading\n```", "limit=40\n# no heading", ["markdown"]),
    ("| a | b |\n| :--- | --- |\n| 1 | 2 |", "a | b\n1 | 2", ["markdown"]),
    ("== 标题 ==\n: 一\n:: 二\n** 三\n'''粗'''与''斜''[[词条|链]][[Category:公告]]", "标题\n一\n二\n- 三\n粗与斜链", ["wiki"]),
    ('{| class="wikitable"\n! 项目 !! 本期\n|-\n| 营收 || 1\n|}', "项目 | 本期\n\n营收 | 1", ["wiki"]),
    ("{{代码|limit:40}}\n{{来源请求}}文", "limit:40\n\n文", ["wiki"]),
    ("\\section{标题}\n\\begin{itemize}\n\\item 一\n\\end{itemize}\n5\\%的\\emph{字}", "标题\n\n- 一\n\n5%的字", ["latex"]),
    ("\\begin{tabular}{ll}\n\\hline\n项目 & 本期 \\\\\n营收 & 1 \\\\\n\\end{tabular}", "项目 | 本期\n营收 | 1", ["latex"]),
    ("\\begin{verbatim}\nif a_b:\n    trip()\n\\end{verbatim}", "if a_b:\n    trip()", ["latex"]),
    ("<p>$k = \\alpha_1$</p>", "$k = \\alpha_1$", ["html", "latex"]),
    ("$$R = \\sum_{i=1}^{n} r_i$$ \\(x\\)", "$R = \\sum_{i=1}^{n} r_i$ $x$", ["latex"]),
    ("文<br/>\n- 一", "文\n\n- 一", ["html", "markdown"]),
]
PLAIN = ["温升>60K，毛利率<5%", "规格为5*3*2毫米", "S=1.732*U*I", "#2主变", "C#程序", "a_b_c", "运费约$1.2每件，另$3", "D:\\data\\out", "详见[注1]", "参数{A}", "评级为A*或B+", "代码段~3~为备用", "R&D部门", "1、一\n2、二", "总资产 *", "：全角冒号", "a | b", "", "   "]


@pytest.mark.parametrize("raw,clean,syntaxes", CASES)
def test_notations(raw, clean, syntaxes):
    assert mk.convert(raw) == (clean, syntaxes)


@pytest.mark.parametrize("raw", PLAIN)
def test_signs_that_are_no_markup(raw):
    clean, syntaxes = mk.convert(raw)
    assert syntaxes == [] and clean.strip() == raw.strip()


def test_density_drops_links_and_keeps_content():
    page = "<div class='nav'><ul></ul><div><a href='a'>首页</a><a href='b'>公告</a><a href='c'>联系我们</a></div></div><div><h1>标题</h1><p>" + "正文内容很长。" * 30 + "</p><table><tr><td>1</td></tr></table></div><nav>导航</nav>"
    clean, _ = mk.convert(page)
    assert "首页" not in clean and "导航" not in clean and clean.startswith("标题") and clean.endswith("1")
    root = mk.tree(page)
    mk.densities(root)
    best, threshold = mk.content(root)
    assert best.chars > 200 and 0 < threshold <= best.density


def test_what_lies_outside_of_the_content():
    body = "<div>" + "".join(f"<p>第{k}段，正文内容很长，并且没有链接。</p>" for k in range(9)) + "<p>短</p></div>"
    page = "<h1>标题</h1><div><p>本站 声明</p><p>**版权**</p></div><ul><li>首<li>页</ul>" + body
    clean, syntaxes = mk.convert(page)
    assert clean.startswith("标题\n第0段") and clean.endswith("短") and "声明" not in clean and "首" not in clean
    assert syntaxes == ["html", "markdown"]  # notation counts where it is left out, too
    # a list is no container: paragraphs around it stay
    assert mk.convert("<p>短段落</p><ul>" + "<li>很长的一项内容，占了大部分篇幅</li>" * 9 + "</ul>")[0].startswith("短段落\n- 很长")


def test_without_caps():
    assert mk.convert("\\textbf{" * 6 + "深" + "}" * 6) == ("深", ["latex"])
    assert mk.convert("\ue0001\ue001 `码`\ufdd0")[0] == "\ue0001\ue001 码\ufdd0"
    assert mk.convert("<div>" * 400 + "深" + "</div>" * 400)[0] == "深"
    assert mk.convert("caf&eacute; &#20013;&#x6587; &copy; R&D; AT&T") == ("café 中文 © R&D; AT&T", ["html"]) and mk.convert("R&D; &foo;")[1] == []


@pytest.mark.parametrize("bad", ["</p></div>", "<p><b>未闭合", "<table><tr><td>a</table><td>b", "<" * 500, "&" * 500, "[[" * 300, "**" * 400, "$" * 401, "{" * 100, "'" * 99, "\ue0005\ue001", "\ufdd05\ufdd1<p>x", "&#xfdd0;5&#xfdd1;<p>", "<a " * 300, "\\" * 51, "<li>" * 3000, "<b>" * 5000 + "x"])
def test_malformed_input_does_not_fail(bad):
    clean, syntaxes = mk.convert(bad)
    assert isinstance(clean, str)


def test_frame(spark):
    rows = [("a", "<p>x</p>"), ("a", "<p>x</p>"), ("b", None), ("c", ""), ("d", "文字" * 100000), ("e", "<p>" + "文字" * 100000 + "</p>")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("clean", mk.F.lit("?")).withColumn("syntaxes", mk.F.lit(1))
    got = sorted((r.id, len(r.clean or "") if r.clean is not None else None, list(r.syntaxes)) for r in mk.clean_markup(df, ["id"], "t").collect())
    assert got == [("a", 1, ["html"]), ("a", 1, ["html"]), ("b", None, []), ("c", 0, []), ("d", 200000, []), ("e", 200000, ["html"])]
    assert mk.clean_markup(df.limit(0), ["id"], "t").count() == 0


ALONE = [":: 一", ":::\t一", ";术语: 义", "; 术语: 义", ">> 引", ">  引", "-\t项", "+\t项", "标题\n---", "标题\n===", "文\r:: 一", "\u3000: 一", "\x1c- 项", "见[https://a.example/x 链接]处"]


def test_every_notation_passes_the_prefilter(spark):
    raws = ALONE + [raw for raw, _, _ in CASES]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, t string")
    got = {r.id: (r.clean, list(r.syntaxes)) for r in mk.clean_markup(df, ["id"], "t", only_marked=True).collect()}
    want = {i: mk.convert(raw) for i, raw in enumerate(raws) if mk.convert(raw)[1]}
    assert {i: got.get(i) for i in want} == want and len(want) == len(raws) - 1  # `;` without a space is none
