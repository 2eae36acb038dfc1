"""Extraction on pages written by hand, in layouts and languages that the training pages do not have.

In each page <!--c--> stands before every block of the article; the mark is taken out before the page is read.
"""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenark.llm import html_text

LONG = "The river rose by two metres in a single night, and by morning the lower streets had become canals. "
PAGES = {
    "blog with sidebar": f"""<html><head><title>My blog</title></head><body class="home"><div id="page"><div id="branding"><a href="/">A Walker's Notebook</a></div>
        <div id="access"><ul><li><a href="/about">About me</a></li><li><a href="/archive">Archive</a></li></ul></div><div id="primary"><div class="hentry"><h2><!--c-->Three days in the hills</h2>
        <p><!--c-->{LONG * 3}</p><p><!--c-->We left before breakfast.</p><ul><li><!--c-->Boots</li><li><!--c-->Two maps, of which one was wrong</li></ul><p><!--c-->{LONG}</p>
        <div class="sharedaddy"><button>Tweet</button><button>Pin it</button></div></div></div><div id="secondary"><h3>Recent posts</h3><ul><li><a href="/1">The coast path</a></li><li><a href="/2">On blisters</a></li><li><a href="/3">Rain</a></li></ul></div>
        <div id="colophon">Proudly powered by nothing. <a href="/rss">RSS</a></div></div></body></html>""",
    "news in German": f"""<body><header class="kopf"><a href="/">Tagblatt</a><nav><a href="/politik">Politik</a> <a href="/sport">Sport</a> <a href="/kultur">Kultur</a></nav></header>
        <div class="hinweis-leiste" role="dialog">Wir verwenden Cookies, um unser Angebot zu verbessern. <button>Einverstanden</button></div>
        <main><article><h1><!--c-->Hochwasser erreicht die Altstadt</h1><p class="vorspann"><!--c-->Am Montagabend stieg der Pegel auf sieben Meter.</p><p><!--c-->Die Feuerwehr räumte zwei Straßen; &Uuml;ber die Schäden ist noch nichts bekannt. {LONG}</p>
        <div class="anzeige">Anzeige: Neue Gummistiefel ab 9 Euro.</div><p><!--c-->„So hoch war es seit 1953 nicht“, sagte der Bürgermeister.</p></article><aside><h3>Mehr zum Thema</h3><ul><li><a href="/a">Karte der Pegel</a></li><li><a href="/b">Was tun bei Hochwasser?</a></li></ul></aside></main>
        <footer><p>© 2024 Tagblatt Verlag</p><a href="/impressum">Impressum</a></footer></body>""",
    "short note with a button": """<body><nav><a href="/">Home</a> <a href="/news">News</a></nav><article><h1><!--c-->Office closed</h1><p><!--c-->The office stays closed on Friday. Calls are answered from Monday on.</p><button>Share</button></article><footer>Contact us</footer></body>""",
    "short note with a select": """<body><div class="nav"><a href="/">Home</a><a href="/x">Shop</a></div><article><p><!--c-->The lift is out of order until further notice. Please use the stairs at the back of the building.</p><select><option>English<option>Français</select></article></body>""",
    "comments inside the article": f"""<body><article class="post"><h1><!--c-->On sourdough</h1><p><!--c-->{LONG}</p><div class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I disagree with all of this, and I have baked for thirty years.</p></div><div class="comment"><b>Bo</b><p>Lovely, thank you!</p></div></div></article></body>""",
    "table layout": f"""<html><body bgcolor=white><table width="100%"><tr><td colspan=2><font size=5><a href="/">Uncle Bob's Page</a></font></td></tr><tr><td valign=top width=120><a href="/">Home</a><br><a href="/trains.html">Trains</a><br><a href="/links.html">Links</a><br><a href="/guest.html">Guestbook</a></td>
        <td valign=top><h2><!--c-->My trains</h2><p><!--c-->{LONG * 2}<p><!--c-->The first one was a gift. It still runs.<p><!--c-->{LONG}</td></tr></table></body></html>""",
    "plain page": f"""<html><body><h1><!--c-->Minutes of the meeting</h1><p><!--c-->Present: five members and a dog.</p><p><!--c-->{LONG}</p><p><!--c-->The meeting closed at nine.</p></body></html>""",
    "documentation": f"""<body><div class="navbar"><a href="/">Docs</a> <a href="/api">API</a><form><input placeholder="Search"><button>Go</button></form></div><div class="container"><div class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Run</a></li><li><a href="#c">Troubles</a></li></ul></div>
        <div class="document"><h1><!--c-->Getting started</h1><p><!--c-->Unpack the archive and run the installer.</p><pre><!--c-->tar xf tool.tar
./install</pre><h2><!--c-->Troubles</h2><table><tr><th><!--c-->Message</th><th><!--c-->Meaning</th></tr><tr><td><!--c-->E12</td><td><!--c-->The disk is full</td></tr></table><blockquote><!--c-->{LONG}</blockquote></div></div><div class="footer">Built yesterday</div></body>""",
    "noscript and scripts": f"""<body><noscript>Please enable JavaScript to use this site.</noscript><script>document.write("<p>not text</p>")</script><section class="story"><h1><!--c-->A bridge reopens</h1><p><!--c-->{LONG}</p><figure><img src=a.jpg><figcaption><!--c-->The bridge in 1901</figcaption></figure><p><!--c-->{LONG}</p></section><style>p {{ color: red }}</style></body>""",
    "newsletter box within": f"""<body><div class="site"><div class="top"><a href="/">The Weekly</a></div><div class="post-content"><h1><!--c-->Why cranes return</h1><p><!--c-->{LONG}</p><div class="newsletter-signup"><p>Get our letter every week.</p><form><input type=email><button>Subscribe</button></form></div><p><!--c-->{LONG}</p><p><!--c-->They rest in the same three fields.</p></div><div class="related-posts"><h4>You may also like</h4><a href="/1">Storks</a><a href="/2">Geese</a><a href="/3">Why birds sing</a></div></div></body>""",
    "French, unclosed": f"""<body><ul class=menu><li><a href=/>Accueil<li><a href=/b>Boutique</ul><div id=contenu><h1><!--c-->La fête du village<p><!--c-->Elle aura lieu dimanche, à partir de dix heures.<p><!--c-->{LONG}<dl><dt><!--c-->Entrée<dd><!--c-->Gratuite pour les enfants de moins de douze ans.</dl></div><div id=pied>Mentions l&eacute;gales</div>""",
    "definition page": f"""<body><header><h1>Wordbook</h1><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a><li><a href=/c>C</a></ul></nav></header><main id="main"><h2><!--c-->quay</h2><p><!--c-->A place where boats are loaded. {LONG}</p><ol><li><!--c-->the old quay<li><!--c-->a quay of stone</ol></main><footer><p>© Wordbook 2021. All rights reserved.</p></footer></body>""",
}


MARK = "\ue000"


def blocks_of(source):
    """(page without marks, the blocks that ought to be found)."""
    marked = html_text.parse(source.replace("<!--c-->", MARK))
    return source.replace("<!--c-->", ""), [text.replace(MARK, "").strip() for _, text in marked.blocks if MARK in text]


def test_pages_of_other_layouts():
    model, found, right, wanted = html_text.default_model(), 0, 0, 0
    for source in PAGES.values():
        clean, own = blocks_of(source)
        got = [line for line in html_text.main_text(clean, model).split("\n") if line]
        found, wanted, right = found + len(got), wanted + len(own), right + len([g for g in got if g in own])
    assert wanted > 40 and right / wanted >= 0.9 and right / found >= 0.9, (right, wanted, found)


@pytest.mark.parametrize("name", ["short note with a button", "short note with a select", "comments inside the article", "noscript and scripts"])
def test_short_articles_stay(name):
    clean, own = blocks_of(PAGES[name])
    assert html_text.main_text(clean, html_text.default_model()) == "\n".join(own)


HOSTILE = {
    "unknown ends": lambda n: "<div>" * n + "</q2>" * n, "quotes without end": lambda n: '<a "' * n, "tags without end": lambda n: "<a " * n, "quoted ends": lambda n: '<a x=">" ' * n,
    "items under a barrier": lambda n: "<li><ul>" + "<div>" * n + "<li></li>" * n, "options in depth": lambda n: "<div>" * n + "<option></option>" * n, "cells in depth": lambda n: "<table><tr><td>" + "<div>" * n + "<td></td>" * n, "open comments": lambda n: "<!-- <p>" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_parsing_is_linear(name):
    def took(n):
        began = time.process_time()
        html_text.parse(HOSTILE[name](n))
        return time.process_time() - began

    small, large = min(took(5_000) for _ in range(3)), min(took(40_000) for _ in range(2))
    assert large < 24 * max(small, 0.01), (small, large)

NAV = '<nav><a href="/">Home</a> <a href="/news">News</a> <a href="/about">About</a></nav>'
FOOT = '<footer><p>© 2024 Example</p><a href="/imprint">Imprint</a></footer>'
LINKED = {
    "linked paragraphs": f'<body>{NAV}<article><h1><!--c-->Ten parks</h1><p><!--c--><a href="/1">The first park is the oldest of them, and the one most people know.</a></p><p><!--c--><a href="/2">The second park has a lake and three small islands.</a></p><p><!--c-->See also <a href="/3">the third park, which lies behind the station</a>.</p></article>{FOOT}</body>',
    "two plain and three linked": f'<body>{NAV}<article><h1><!--c--><a href="/self">Why we walk</a></h1><p><!--c-->{LONG}</p><p><!--c--><a href="/2">A study of four thousand walkers came to the same result last year.</a></p><p><!--c--><a href="/3">Another one did not.</a></p><p><!--c--><a href="/4">Both were paid for by makers of shoes.</a></p><p><!--c-->{LONG}</p></article><aside class="related"><h3>Related</h3><ul><li><a href="/a">Running</a></li><li><a href="/b">Cycling</a></li></ul></aside>{FOOT}</body>',
    "list article with linked headings": f'<body><div class="menu"><a href="/">Start</a><a href="/x">Places</a></div><div class="entry-content"><h1><!--c-->Three parks</h1><h2><!--c--><a href="/p1">Park 1</a></h2><p><!--c-->{LONG}</p><h2><!--c--><a href="/p2">Park 2</a></h2><p><!--c-->{LONG}</p><h2><!--c--><a href="/p3">Park 3</a></h2><p><!--c-->It is small.</p></div>{FOOT}</body>',
    "sources at the end": f'<body>{NAV}<main><article><h1><!--c-->The flood of 1953</h1><p><!--c-->{LONG * 2}</p><p><!--c-->{LONG}</p><h2><!--c-->Sources</h2><ul><li><!--c--><a href="/s1">Report of the water board, 1954</a></li><li><!--c--><a href="/s2">Letters of the mayor</a></li><li><!--c--><a href="/s3">Map of the lower town</a></li></ul></article></main>{FOOT}</body>',
    "further reading, ordered": f'<body>{NAV}<div id="content"><h1><!--c-->On yeast</h1><p><!--c-->{LONG}</p><p><!--c-->{LONG}</p><h3><!--c-->Further reading</h3><ol><li><!--c--><a href=/1>Bread and its makers</a><li><!--c--><a href=/2>The sour book</a></ol></div><div class="sidebar"><h3>Popular</h3><ul><li><a href=/q>Ten loaves</a><li><a href=/w>Salt</a></ul></div>{FOOT}</body>',
    "quotation that is a link": f'<body><header><a href="/">Site</a></header><article><p><!--c-->{LONG}</p><blockquote><!--c--><a href="/q">Nobody had seen the water so high, and nobody has since.</a></blockquote><p><!--c-->{LONG}</p></article>{FOOT}</body>',
    "caption that is a link": f'<body>{NAV}<article><h1><!--c-->A bridge</h1><p><!--c-->{LONG}</p><figure><img src=a><figcaption><!--c--><a href="/f">The bridge in 1901</a></figcaption></figure><p><!--c-->{LONG}</p></article></body>',
    "glossary of links": f'<body><ul class="nav"><li><a href=/>A</a><li><a href=/b>B</a></ul><article class="post"><h1><!--c-->Words of the sea</h1><p><!--c-->{LONG}</p><dl><dt><!--c--><a href=/k>keel</a><dd><!--c-->The lowest timber of a ship.<dt><!--c--><a href=/m>mast</a><dd><!--c-->The pole that carries the sails.</dl></article>{FOOT}</body>',
    "table of links": f'<body>{NAV}<article><h1><!--c-->Stations</h1><p><!--c-->{LONG}</p><table><tr><th><!--c-->Name</th><th><!--c-->Height</th></tr><tr><td><!--c--><a href=/1>North Peak</a></td><td><!--c-->1,204 m</td></tr><tr><td><!--c--><a href=/2>Low Gap</a></td><td><!--c-->611 m</td></tr></table></article>{FOOT}</body>',
    "linked lead": f'<body>{NAV}<main><div class="article-body"><h1><!--c-->Ferry strike ends</h1><p><!--c--><a href="/live">Follow the day as it happened.</a></p><p><!--c-->{LONG}</p><p><!--c-->{LONG}</p></div></main><div class="related"><a href=/1>More ferries</a><a href=/2>Ports</a></div>{FOOT}</body>',
    "news with related box": f'<body>{NAV}<article><h1><!--c-->Cranes return</h1><p><!--c-->{LONG}</p><aside class="related"><h4>Read more</h4><ul><li><a href=/1>Storks</a></li><li><a href=/2>Geese</a></li></ul></aside><p><!--c-->{LONG}</p><p><!--c-->They rest in <a href=/f>the same three fields</a> as ever.</p></article>{FOOT}</body>',
    "blog with tags and share": f'<body><div id="header"><h1><a href="/">A blog</a></h1></div><div class="post"><h2><!--c--><a href="/p/1">Rain again</a></h2><p><!--c-->{LONG}</p><p><!--c-->{LONG}</p><div class="tags"><a href=/t/1>rain</a> <a href=/t/2>spring</a></div><div class="share"><a href=#>Tweet</a> <a href=#>Mail</a></div></div>{FOOT}</body>',
    "recipe": f'<body>{NAV}<article><h1><!--c-->Soup</h1><p><!--c-->{LONG}</p><h2><!--c-->You need</h2><ul><li><!--c-->two <a href=/o>onions</a></li><li><!--c--><a href=/s>stock</a></li><li><!--c-->salt</li></ul><ol><li><!--c-->Cut the onions.<li><!--c-->Boil all of it for an hour.</ol></article>{FOOT}</body>',
    "index page without an article": f'<body>{NAV}<ul class="sidebar"><li><a href=/1>One</a><li><a href=/2>Two</a></ul>{FOOT}</body>',
    "wiki": f'<body><div id="mw-navigation"><ul><li><a href=/a>Main page</a></li><li><a href=/b>Random</a></li></ul></div><div id="bodyContent"><h1><!--c-->Quay</h1><p><!--c-->A <b>quay</b> is a <a href=/p>place</a> where <a href=/b>boats</a> are <a href=/l>loaded</a>.</p><p><!--c-->{LONG}</p><h2><!--c-->See also</h2><ul><li><!--c--><a href=/h>Harbour</a></li><li><!--c--><a href=/pier>Pier</a></li></ul></div><div id="footer"><ul><li><a href=/pr>Privacy</a></li></ul></div></body>',
    "interview": f'<body>{NAV}<section class="story"><h1><!--c-->Four questions</h1><p><!--c--><b>Why now?</b></p><p><!--c-->Because.</p><p><!--c--><b>Who pays?</b></p><p><!--c-->{LONG}</p></section><section class="newsletter"><p>Get our letter</p><form><input><button>Go</button></form></section>{FOOT}</body>',
    "press release": f'<body>{NAV}<div class="main-content"><h1><!--c-->New ferry named</h1><p><!--c-->{LONG}</p><p><!--c-->Contact: <a href="mailto:x@example.com">the press office of the harbour</a></p></div>{FOOT}</body>',
    "links in Spanish": f'<body><nav class="menu"><a href=/>Inicio</a><a href=/n>Noticias</a></nav><article class="contenido"><h1><!--c-->El río crece</h1><p><!--c-->El agua subió dos metros en una noche y las calles bajas quedaron cubiertas.</p><p><!--c--><a href=/m>El alcalde habló con los vecinos el martes.</a></p><p><!--c-->Nadie resultó herido.</p></article><div class="aviso">Usamos cookies. <button>Aceptar</button></div></body>',
    "timeline": f'<body>{NAV}<article><h1><!--c-->The works</h1><ul><li><!--c-->1901: begun</li><li><!--c-->1904: <a href=/x>the great strike</a></li><li><!--c-->1911: ended</li></ul><p><!--c-->{LONG}</p></article>{FOOT}</body>',
}


def test_links_of_the_article_stay():
    model, right, wanted = html_text.default_model(), 0, 0
    for source in LINKED.values():
        clean, own = blocks_of(source)
        got = [line for line in html_text.main_text(clean, model).split("\n") if line]
        assert not set(got) - set(own)
        wanted, right = wanted + len(own), right + sum(g in own for g in got)
    assert wanted > 80 and right / wanted >= 0.85, (right, wanted)


@pytest.mark.parametrize("name", ["linked paragraphs", "two plain and three linked", "list article with linked headings", "quotation that is a link", "table of links", "linked lead", "press release", "timeline"])
def test_linked_blocks_stay(name):
    clean, own = blocks_of(LINKED[name])
    assert html_text.main_text(clean, html_text.default_model()) == "\n".join(own)


def test_other_attributes_are_neither_names_nor_labels():
    plain = f"<body>{NAV}<article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article>{FOOT}</body>"
    odd = plain.replace("<article>", '<article data-y="10" data-id="nav" data-class="menu sidebar" aria-role="banner">').replace("<h1>", '<h1 data-y="b">').replace("<p>", "<p title='class=advert id=footer' data-y=''>")
    assert html_text.parse(odd) == html_text.parse(plain)
    assert html_text.parse('<p CLASS=Ad id = "x1 y">a</p>').features[1][:3] == ("tag:p", "name:ad", "name:x") and html_text.parse('<p data-y="c">a</p>', labelled=True).labels[1] == html_text.CONTENT


@given(st.lists(st.tuples(st.text("abcdehilnorsty-=\"'/<> \t\n&", max_size=9), st.text(max_size=12)), max_size=5), st.sampled_from(["div", "p", "li", "data-y", "td"]))
@settings(max_examples=300, deadline=None)
def test_no_attribute_ends_the_job(attributes, tag):
    page = f"<{tag} " + " ".join(f"{k}={v}" for k, v in attributes) + f' data-y="{tag}">text</{tag}><p data-y=10>more'
    html_text.main_text(page, html_text.default_model())
