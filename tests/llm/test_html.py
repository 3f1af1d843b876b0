from __future__ import annotations

from marketloom.llm import html

SCHEMA = "page_id long, url string, html string"


def words(name, n=30):
    return " ".join(f"{name}{k}" for k in range(n))


def labelled(k):
    return (
        f"<html><head><title>t{k}</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>n{k}</a></li></ul></nav>"
        f"<div class='ad'>buy {words('z', k % 20)}</div><article><h1>H{k}</h1><p>{words('a', 5 + k % 40)}<p><b>{words('b', 3)}</b></article>"
        f"<footer>&copy; {words('f', k % 15)}</footer></body></html>"
    )


def texts(df, **more):
    return {r.page_id: r.text for r in html.extract(df, **more).collect()}


def test_marked_pages_are_read_whole(table):
    got = texts(table(SCHEMA, *[(k, f"u{k}", labelled(k)) for k in range(60)]))
    assert got == {k: f"H{k}\n{words('a', 5 + k % 40)}\n{words('b', 3)}" for k in range(60)}


def test_other_layouts(table):
    rows = [(k, "u", labelled(k)) for k in range(40)]
    rows += [
        (100, "u", f"<body><header><a>Home</a> Site</header><div id='content'><h1>Title</h1><p>{words('a')} <em>x</em>&nbsp;&lt;y&gt;</p><ul><li>item</li></ul><p>{words('b')}</p></div><div class='comments'><p>{words('c')}</p></div><div class='sidebar'>{words('s')}</div></body>"),
        (101, "u", f"<div class=ad>open {words('z', 9)}<article><p>{words('a')}<div class='cookie-notice'>we use</div><form>f<input></form><script>var t='</p>'</script><p>{words('b')}</p><section class='comments'><article class='comment'>{words('q')}</article></section></article>"),
        (102, "u", f"<main><p>one <!-- <p>no</p> --> two<br>three</p><p title='a > b'>{words('a', 12)}</p></main>"),
    ]
    got = texts(table(SCHEMA, *rows))
    assert got[100] == f"Title\n{words('a')} x <y>\nitem\n{words('b')}"
    assert got[101] == f"{words('a')}\n{words('b')}"
    assert got[102] == f"one two three\n{words('a', 12)}"


def test_nulls_long_broken_and_clashing(table):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "   "), (4, "u", "<p"), (5, "u", "<article><p>" + "w " * 200_000), (None, "u", "plain < text &amp; more"), (6, "u", "<" * 5000 + "x"), (6, "u", "<div>" * 3000 + "deep words here")]
    df = table(SCHEMA + ", text int, n_chars string", *[(*r, 1, "x") for r in rows])
    got = html.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got if r.page_id != 6}
    assert by[1] == by[2] == by[3] == "" and by[5] == "w " * 199_999 + "w" and by[None] == "plain < text & more"
    assert html.extract(table(SCHEMA)).count() == 0


def test_region_is_the_best_sum():
    import itertools
    import random

    r = random.Random(1)
    for _ in range(200):
        scores = [r.choice([-3.0, -1.0, -0.5, 0.5, 2.0]) for _ in range(r.randint(0, 12))]
        first, end = html.region(scores)
        best = max([0.0] + [sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2)])
        assert sum(scores[first:end]) == best


def test_long_blocks_within_an_article_part_nothing(table):
    rows = [(k, "u", labelled(k)) for k in range(60)]
    blocks = [f"<div class=ad>{words('z', 100)}</div>", f"<aside><ul>{''.join(f'<li>{w}</li>' for w in words('s', 600).split())}</ul></aside>", f"<form>{words('f', 900)}</form>"]
    for k, block in enumerate(blocks):
        rows.append((100 + k, "u", f"<body><nav>n</nav><article><p>{words('a', 60)}</p>{block}<p>{words('b', 200)}</p></article></body>"))
        rows.append((200 + k, "u", f"<body><div id=content><p>{words('a', 60)}</p>{block}<p>{words('b', 200)}</p></div></body>"))
        rows.append((300 + k, "u", f"<body><p>{words('a', 60)}</p>{block}<p>{words('b', 200)}</p></body>"))
    got = texts(table(SCHEMA, *rows))
    assert {got[k] for k in got if k >= 100} == {f"{words('a', 60)}\n{words('b', 200)}"}


def test_names_do_not_hide_what_holds_the_page(table):
    rows = [(k, "u", labelled(k)) for k in range(60)]
    text = f"<p>{words('a', 60)}</p><p>{words('b', 60)}</p>"
    pages = [
        f"<body class='single has-sidebar'><p>{words('a', 60)}</p><p>{words('b', 60)}</p></body>",
        f"<body><div class='content no-sidebar'>{text}</div><div class=sidebar>{words('s', 30)}</div></body>",
        f"<body><article class='post comments-open'>{text}</article><div class=comments>{words('c', 400)}</div></body>",
        f"<body><nav>n</nav><article class='category-social'>{text}<section class=comments><article class=comment>{words('q')}</article></section></article></body>",
        f"<html class='no-cookie'><body><main class=social>{text}</main></body></html>",
        f"<body><div class='page has-sidebar'><div class='content comments-open'>{text}</div></div></body>",
    ]
    got = texts(table(SCHEMA, *rows, *[(100 + k, "u", page) for k, page in enumerate(pages)]))
    for k in range(len(pages)):
        assert got[100 + k] == f"{words('a', 60)}\n{words('b', 60)}", k


def test_all_of_a_marked_article_and_nothing_else(table):
    rows = [(k, "u", labelled(k)) for k in range(60)]
    text = f"<p>{words('a', 60)}</p>"
    items = "".join(f"<li>{w}</li>" for w in words("i", 9).split())
    cells = "".join(f"<tr><td>{w}</td></tr>" for w in words("x", 9).split())
    pages = {
        f"<body><nav><ul><li>n</li></ul></nav><article><ul>{items}</ul></article><footer>f</footer></body>": words("i", 9).replace(" ", "\n"),
        f"<body><article><table>{cells}</table></article></body>": words("x", 9).replace(" ", "\n"),
        f"<body><article>{text}<ul>{items[:36]}</ul></article><div>more</div></body>": f"{words('a', 60)}\ni0\ni1\ni2",
        f"<body><article><header><h1>Title</h1></header><section><h2>Intro</h2></section>{text}</article></body>": f"Title\nIntro\n{words('a', 60)}",
        f"<body><div class=left>{words('l', 40)}</div><article>{text}</article><div class='more-stories'>{words('m', 40)}</div></body>": words("a", 60),
        f"<body><article>{text}</article><section id=responses><p>{words('r', 90)}</p></section><div id=replies>{words('q', 90)}</div></body>": words("a", 60),
        f"<body><article>{text}<div id=replies>{words('q', 40)}</div><p class=copyright>c</p><h2 id='social-change'>Change</h2><p>end</p></article><div id=foot>f</div></body>": f"{words('a', 60)}\nChange\nend",
        f"<body><main><div>{'<i></i>' * 5000}</div><p>one</p>{'<b></b>' * 5000}<p>two</p></main></body>": "one\ntwo",
        f"<body><article>{text}</article><div class=left>{words('l', 40)}</div><article><p>{words('b', 60)}</p></article></body>": f"{words('a', 60)}\n{words('b', 60)}",
    }
    got = texts(table(SCHEMA, *rows, *[(100 + k, "u", page) for k, page in enumerate(pages)]))
    for k, wanted in enumerate(pages.values()):
        assert got[100 + k] == wanted, k
    assert all(got[k] == f"H{k}\n{words('a', 5 + k % 40)}\n{words('b', 3)}" for k in range(60))


def test_teasers_mark_nothing(table):
    rows = [(k, "u", labelled(k)) for k in range(60)]
    page = f"<body><div id=content><p>{words('a', 60)}</p><p>{words('b', 60)}</p></div>{''.join(f'<article><h3>t{k}</h3></article>' for k in range(5))}</body>"
    assert texts(table(SCHEMA, *rows, (100, "u", page)))[100].startswith(f"{words('a', 60)}\n{words('b', 60)}")


def test_lists_of_unmarked_pages(table):
    rows = [(k, "u", labelled(k)) for k in range(60)]
    items = "".join(f"<li>{w}</li>" for w in words("i", 9).split())
    page = f"<body><nav><ul><li>n</li></ul></nav><p>{words('a', 60)}</p><ul>{items}</ul><p>end</p><footer>f</footer></body>"
    assert texts(table(SCHEMA, *rows, (100, "u", page)))[100] == "\n".join([words("a", 60), words("i", 9).replace(" ", "\n"), "end"])
