from doclake.functions import cleaning as C


def test_noise_lines_and_trailing_copy_go(one):
    text = "Home\nIntro text\nNext page\nBackend guide\nEdit on GitHub\nplease make a copy\ngive us feedback now\nend here"
    assert one(C.clean_markdown, text) == "Intro text\nplease make a\nend here"


def test_menu_word_takes_the_blank_lines_after_it(one):
    assert one(C.strip_noise, "a\nMenu:\n\n\nb") == "a\nb"


def test_forward_takes_the_line_after_a_blank(one):
    assert one(C.strip_noise, "a\nForward\n\ngone\nb") == "a\nb"


def test_folded_letters_match_like_ascii(one):
    assert one(C.strip_noise, "a\nſhare this now\nb") == "a\nb"
    assert one(C.strip_noise, "a\nEDİT ON GıTHUB\nb") == "a\nb"


def test_short_lines_and_rules(one):
    text = "OK\nfi\n--\n{\n| - |\nabc\nx1\n(a"
    assert one(C.drop_noise_lines, text) == "{\nabc\n(a"


def test_blank_lines_collapse(one):
    assert one(C.collapse_blanks, "\n\n a\n \n\t\n\nb\n\n\n") == " a\n\nb\n"


def test_line_rules(one):
    text = "***b*** ___i___ [t]( ) wait..... no!!! why???  "
    assert one(C.normalize_lines, text) == "**b** __i__ t wait... no! why?"


def test_line_emptied_by_a_link_is_dropped_not_blank(one):
    assert one(C.clean_lines, "long line\n[ ]()\nother line") == "long line\nother line"


def test_artifacts(one):
    text = "a [![b](i)](l) [ ] ![ ] z\n\n|\n\nq\n ----- \nend"
    assert one(C.strip_artifacts, text) == "a   ! zqend"


def test_adjacent_headings(one):
    text = "intro\n# One\n# Two\nbody"
    assert one(C.normalize_whitespace, text) == "intro\n\n# One\n\n# Two\nbody"


def test_blank_and_null_text(one, spark):
    assert one(C.clean_markdown, " \n \t") == ""
    assert spark.createDataFrame([(None,)], "c string").select(C.clean_markdown("c").alias("o")).first()["o"] == ""


def test_unicode_spaces(one):
    assert one(C.clean_markdown, " tail kept  \nnext is no start\x1f") == "tail kept"
