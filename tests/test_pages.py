from adlake.operators import pages

LISTING = """
<html><body><!-- <a href="/ads/job/unseen-1">no</a> --><script>var s = '<a href="/ads/job/unseen-2">';</script>
<a class="x" href="/ads/job/heron-feeder-17">Heron feeder</a>
<a href='https://mirror.example/job/reed-cutter-40?a=1&amp;b=2'>Reed cutter</a>
<A HREF=/ads/job/dyke-warden-66>Dyke warden</A> <a href="/ads/job/heron-feeder-17">again</a>
<a href="//static.example/job/eel">x</a><a href="job/tail">y</a><a data-href="/job/no" href="/about">about</a>
</body></html>"""

DETAIL = """
<html><head><title>Page</title><style>.b2b{}</style></head><body>
<h1>Principal <b>Otter</b> Architect</h1>
<div class="company">Marsh Atlas</div>
<div class="salary">31000 - 34500 PLN</div>
<div class="location">Sopot, remote</div>
<span class="tech-tag">Kotlin</span> <span class="tech-tag">Oracle</span> <span class="tech-tag">Ansible</span>
<span class="tech-tag">Linux</span><span class="tech-tag">Kotlin</span><span class="tech-tag">R</span>
<div class="job-description"><p>Count otters &amp; eels.</p><p>At <i>dusk</i></p></div>
<ul class="requirements"><li>Boots<li>Patience</ul>
<p>pełny etat</p></body></html>"""

BARE = "<html><body><h1>Eel</h1><p class='subtitle'>Eel person</p><p>Pay: 7 000 - 8 500 PLN. Go and Java, C# junior</p></body></html>"


def frame(spark, *htmls, url="https://jobs.example/job/otter-9"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def test_links_in_page_order(spark):
    rows = pages.page_links(frame(spark, LISTING)).orderBy("position").collect()
    assert [r.url for r in rows] == [
        "https://jobs.example/ads/job/heron-feeder-17", "https://mirror.example/job/reed-cutter-40?a=1&b=2",
        "https://jobs.example/ads/job/dyke-warden-66", "https://static.example/job/eel"]


def test_unique_and_capped(spark):
    links = pages.page_links(frame(spark, LISTING, LISTING))
    assert pages.unique_urls(links).count() == 4
    assert pages.capped(pages.unique_urls(links)).count() == 4
    assert [r.url for r in pages.capped(pages.unique_urls(links), 1).collect()] == ["https://jobs.example/ads/job/dyke-warden-66"]


def test_detail_page(spark):
    row = pages.parse_details(frame(spark, DETAIL)).first()
    assert row.job_id == "otter-9"
    assert row.title == "PrincipalOtterArchitect"  # pieces are stripped and joined without a separator
    assert (row.company_name, row.salary, row.location) == ("Marsh Atlas", "31000 - 34500 PLN", "Sopot, remote")
    assert row.description == "Count otters & eels.\nAt\ndusk"
    assert row.requirements == "Boots\nPatience"
    assert row.technologies == ["Kotlin", "Oracle", "Ansible", "Linux"]
    assert (row.seniority, row.employment_type) == ("senior", "full-time")


def test_fallbacks(spark):
    row = pages.parse_details(frame(spark, BARE, url="https://h/x")).first()
    assert (row.title, row.company_name) == ("Eel person", "Unknown Company")
    assert row.salary == "7 000 - 8 500 PLN"
    assert row.technologies == ["Java", "Go"]
    assert (row.description, row.requirements, row.location) == (None, None, None)
    assert (row.seniority, row.employment_type) == ("junior", None)


def test_later_tests_count_when_the_first_element_is_empty(spark):
    html = """<h1>Developer</h1><div class="company-logo"></div><span class="company">Firm</span>
      <p class="salary-note">none</p><span class="salary">9 000 PLN</span><i class="skill">Go</i>
      <span class="tag">SQL</span><div class="tags"><span>Rust</span><b><span>Zig</span></b></div><span>not</span>"""
    row = pages.parse_details(frame(spark, html)).first()
    assert (row.company_name, row.salary) == ("Firm", "9 000 PLN")
    assert row.technologies == ["Go", "SQL", "Rust", "Zig"]


def test_pages_without_markup_give_no_ad(spark):
    assert pages.parse_details(frame(spark, "", None)).count() == 0


def test_native_title_agrees_with_parser(spark):
    df = frame(spark, DETAIL, "<h1>Tiny</h1>", "<p>none</p>")
    native = [r.title for r in df.orderBy("page_id").select(pages.page_title(df.html).alias("title")).collect()]
    parsed = [r.title for r in pages.parse_details(df).orderBy("page_id").collect()]
    assert native == parsed == ["PrincipalOtterArchitect", "Unknown Title", "Unknown Title"]


NEXT = [
    ('<a href="x" rel="next">2</a>', True), ('<a rel="next nofollow">2</a>', False), ('<a class="btn next">2</a>', True),
    ('<a class="nextish">2</a>', False), ('<a aria-label="go next">2</a>', True), ('<button class="next">2</button>', True),
    ('<a href="x"><i>Next</i> page</a>', True), ("<a>Następna</a>", True), ('<a title="Next">2</a>', False),
    ('<a rel="next" disabled="disabled">2</a>', False), ('<a rel="next" disabled>2</a>', True),
    ('<a rel="next" disabled="1">2</a><a class="next">2</a>', True), ("<p>Next</p>", False), ("<!-- <a rel=\"next\"> -->", False),
    (None, False),
]


def test_next_page(spark):
    df = frame(spark, *[h for h, _ in NEXT])
    got = [r[0] for r in df.orderBy("page_id").select(pages.has_next_page(df.html)).collect()]
    assert got == [want for _, want in NEXT]


def test_whole_texts_unless_a_limit_is_given(spark):
    html = f"<h1>Long pages</h1><div class='description'>{'d' * 6000}</div>" + "".join(f"<i class='skill'>s{i}</i>" for i in range(70))
    row = pages.parse_details(frame(spark, html)).first()
    assert (len(row.description), len(row.technologies)) == (6000, 70)
    row = pages.parse_details(frame(spark, html), max_text=10, max_technologies=3).first()
    assert (row.description, row.technologies) == ("d" * 10, ["s0", "s1", "s2"])


def test_unclosed_elements_end_where_html_ends_them(spark):
    html = """<h1>Loose markup</h1><p class="description">a<div class="about">b</div>
      <table><tr><td class="salary">10<td>20<tr><td class="location">Gdynia<th>no</table>
      <dl><dt class="company">Marsh Atlas<dd>not this</dl><select><option class="skill">Go<option>no</select>"""
    row = pages.parse_details(frame(spark, html)).first()
    assert (row.description, row.salary, row.location, row.company_name, row.technologies) == ("a", "10", "Gdynia", "Marsh Atlas", ["Go"])


def test_listing_prefix(spark):
    df = spark.createDataFrame(
        [("r", 1, 20, True), ("r", 2, 20, False), ("r", 3, 20, True), ("s", 1, 20, True), ("s", 2, 0, True),
         ("t", 1, 5, True), ("t", 2, 5, True), ("t", 3, 5, True)], "run_id string, page int, n_links int, has_next boolean")
    got = {tuple(r)[:2] for r in pages.harvested_pages(df, 2).collect()}
    assert got == {("r", 1), ("r", 2), ("s", 1), ("t", 1), ("t", 2)}


def test_capture_statistics(spark):
    listing = spark.createDataFrame([("r", 1, 3), ("r", 2, 2)], "run_id string, page int, n_links bigint")
    details = frame(spark, DETAIL, BARE, "")
    assert tuple(pages.capture_statistics(listing, details, pages.parse_details(details)).first()) == (2, 5, 2, 0)


def test_pages_are_given_on_before_the_batch_ends():
    import pyarrow as pa

    html = ["<h1>Senior Developer</h1><span class='tag'>Go</span>"] * 1000 + ["<p>" + "x" * 600_000 + "</p>"] * 5 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(html)), pa.int64()), pa.array([f"u{i}" for i in range(len(html))]), pa.array(html)],
                                       names=["page_id", "url", "html"])
    parts = list(pages.page_walk()([batch]))
    assert max(part.num_rows for part in parts) <= 256 and max(part.nbytes for part in parts) < 3_000_000
    whole = pa.Table.from_batches(parts)
    assert whole.column("page_id").to_pylist() == list(range(len(html)))
    assert whole.column("title").to_pylist() == ["Senior Developer"] * 1000 + [None] * 7 and whole.column("tags")[0].as_py() == ["Go"]
    assert list(pages.page_walk()([batch.slice(0, 0)])) == []
