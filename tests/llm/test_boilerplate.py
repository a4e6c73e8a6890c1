from wirelake.llm import boilerplate as B


def test_markup_is_read_with_implied_ends():
    page = "<nav><a href=x>Home</a> <a>World</a>\n</nav>\n<p>The council met in March and voted.\n<p>It voted again.\n<div style='display:none'>Unseen words of the page here.</div>\n<ul><li>First point\n<li>Second point</ul>\n<table><tr><td>Towns<td>12\n<tr><td>Rivers and lakes<td>7</table>\n<!-- a note -->\n&copy; kept"
    lines = page.split("\n")
    assert B.hidden_lines(page, None, B.Known()) == [0, 1, 4, 9]
    shown = B.render(page, None, B.Known()).split("\n\n")
    assert shown[:2] == ["The council met in March and voted.", "It voted again."]
    assert shown[2] == "First point\nSecond point"
    assert shown[3] == "Towns             12\nRivers and lakes  7"
    assert len(lines) == 11


def test_cells_of_plain_lines_are_aligned():
    page = "The vote was close in all towns.\nAvon: 23 seats\nLongtown: 112 seats\nThat was all."
    assert B.render(page, None, B.Known()) == "The vote was close in all towns.\n\nAvon:      23 seats\nLongtown:  112 seats\n\nThat was all."


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page long, site string, publisher string, text string")


def test_rare_notices_single_sites_and_copies(spark):
    """A long notice on three pages of one site is furniture, a story copied five times isn't, whatever else there is."""
    story = "Mayor {0} opened the bridge of {0} on Monday.\nThe bridge of {0} had been closed for years, {0} said."
    names = [f"{a}{b}town" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, f"s{i % 7}", f"P{i % 7}", story.format(n)) for i, n in enumerate(names)]
    rows += [(200 + i, "s1", "P1", story.format(f"zz{'abc'[i]}") + "\nPlease sign in to P1 to go on reading this story.") for i in range(3)]
    rows += [(300 + i, f"s{i}", f"P{i}", "A tale told in full on each of five sites today.\nIt ends like this on all of them, they say.") for i in range(5)]
    rows += [(400, None, None, None), (401, "s1", None, ""), (402, None, None, " \n\n"), (403, None, None, "Sole line without a site.")]
    got = sorted(tuple(r) for r in B.site_lines(_pages(spark, rows)).collect())
    assert got == [(200, 2), (201, 2), (202, 2)]
    main = {r.page: r.main for r in B.main_text(_pages(spark, rows)).collect()}
    assert main[200] == story.format("zza").replace("\n", "\n\n") and main[402] == "" and 400 not in main and 401 not in main


def test_menus_are_known_by_their_labels(spark):
    menus = ["Home | World | Sport", "Sport Home World", "World\nHome"]
    rows = [(i, f"s{i % 4}", "P", f"{menus[i % 3]}\nThe council of Town{chr(97 + i)}x{chr(97 + i % 5)} met again on Monday and voted.") for i in range(24)]
    got = {(r.page, r.line_no) for r in B.site_lines(_pages(spark, rows)).collect()}
    assert got == {(i, n) for i in range(24) for n in range(2 if i % 3 == 2 else 1)}


def test_no_pages(spark):
    assert B.site_lines(_pages(spark, [])).count() == 0 and B.main_text(_pages(spark, [])).count() == 0
