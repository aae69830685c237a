"""The extraction of main text: hand-written pages with their exact text, and the chain itself."""

import itertools

import numpy as np
import pytest

from skeinlake.llm import html_blocks, html_extract
from skeinlake.llm.html_extract import Chain, default_chain, main_text

#: (page, blocks of the article); none of them is made by the generator of training pages.
LAYOUTS = {
    "header in the article, aside, comments": (
        """<body><article><header><h1>Rivers of the north</h1></header><p>The river rises in the hills above the town and runs to the sea.</p>
        <aside><h4>See also</h4><p>Ten walks along the coast.</p></aside><p>It freezes in most winters, and ships wait for the thaw.</p></article>
        <section id="comments"><h3>2 comments</h3><article><p>Lovely piece, thank you.</p></article><article><p>I grew up there!</p></article></section></body>""",
        ["Rivers of the north", "The river rises in the hills above the town and runs to the sea.", "It freezes in most winters, and ships wait for the thaw."],
    ),
    "one short paragraph": ("<nav><a href=/>Home</a> <a href=/b>Blog</a></nav><article><p>Short one.</p></article><footer>Imprint</footer>", ["Short one."]),
    "paragraph, aside, paragraph": (
        "<html><body><nav><ul><li><a href=1>News</a><li><a href=2>Sport</a></ul></nav><article><p>The council met on Monday to vote on the new bridge.</p><aside>Subscribe for updates.</aside><p>The vote passed.</p></article><footer>About us</footer>",
        ["The council met on Monday to vote on the new bridge.", "The vote passed."],
    ),
    "a misleading class on main": (
        '<header><a href="/">Daily Post</a></header><main class="popular-content"><h1>Why bread rises</h1><p>Yeast eats sugar and gives off gas.</p><p>That gas lifts the dough.</p></main><footer>Contact</footer>',
        ["Why bread rises", "Yeast eats sugar and gives off gas.", "That gas lifts the dough."],
    ),
    "mathematics in a sentence": (
        "<article><h1>Area</h1><p>A circle of radius <math><mi>r</mi></math> has the area <math><semantics><mrow><mi>π</mi><msup><mi>r</mi><mn>2</mn></msup></mrow><annotation>\\pi r^2</annotation></semantics></math>, as is well known.</p></article>",
        ["Area", "A circle of radius r has the area πr2, as is well known."],
    ),
    "byline before the text": (
        '<article><h1>A quiet year for bees</h1><div class="meta-content">By Ann Example, 3 May</div><p>Beekeepers report fewer losses than in the year before.</p></article>',
        ["A quiet year for bees", "Beekeepers report fewer losses than in the year before."],
    ),
    "blog theme": (
        """<body class="home blog has-sidebar"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">My blog</a></p><nav class="main-navigation"><ul><li><a href="/about">About</a></li></ul></nav></header>
        <div id="content" class="site-content"><div id="primary"><main id="main"><article class="post-12 post type-post category-travel tag-social"><header class="entry-header"><h1 class="entry-title">Two days in Porto</h1>
        <div class="entry-meta">Posted on <time>1 June</time> by <a href="/u">Kim</a></div></header><div class="entry-content"><p>We came by train, late in the evening.</p><h2>The first day</h2><p>It rained, so we saw museums.</p><ul><li>Art</li><li>Port wine</li></ul></div>
        <footer class="entry-footer">Filed under <a href="/t">Travel</a></footer></article><div id="comments" class="comments-area"><h2>One thought</h2><ol class="comment-list"><li><p>Nice trip!</p></li></ol><div id="respond"><form><label>Name</label><textarea></textarea></form></div></div></main></div>
        <aside id="secondary" class="widget-area"><h2>Archive</h2><ul><li><a href="/5">May</a></li></ul></aside></div><footer id="colophon"><p>Proudly powered by a blog.</p></footer></div></body>""",
        ["Two days in Porto", "We came by train, late in the evening.", "The first day", "It rained, so we saw museums.", "Art", "Port wine"],
    ),
    "tables for layout": (
        """<table width=100%><tr><td class=menu><a href=a>Start</a><br><a href=b>Links</a></td><td class=content><h1>Repairing clocks</h1><p>First take off the hands. They bend easily, so use two levers.</p><p>Then open the back.</p></td></tr><tr><td colspan=2 class=footer>&copy; 1999 The clock page</td></tr></table>""",
        ["Repairing clocks", "First take off the hands. They bend easily, so use two levers.", "Then open the back."],
    ),
    "plain page": ("<h1>Notes</h1><p>These are the notes that I took in the meeting of Tuesday.</p><p>Nothing was decided.</p>", ["Notes", "These are the notes that I took in the meeting of Tuesday.", "Nothing was decided."]),
    "cookie notice first": (
        '<div id="cookie-consent"><p>We use cookies to improve this site. Read our policy to learn more.</p><button>Accept</button></div><main><h1>Tide tables</h1><p>High water is at noon today and twenty minutes later each day.</p></main>',
        ["Tide tables", "High water is at noon today and twenty minutes later each day."],
    ),
    "adverts between paragraphs": (
        '<article><p>Wool shrinks when it is washed hot.</p><div class="ad-slot"><p>Buy our detergent! It is the best.</p></div><p>Wash it cold and dry it flat.</p><div class="advertisement">Half price today.</div><p>Silk is alike.</p></article>',
        ["Wool shrinks when it is washed hot.", "Wash it cold and dry it flat.", "Silk is alike."],
    ),
    "a form around the page": (
        '<form id="aspnetForm" method="post" action="./p.aspx"><div class="header"><a href="/">City hall</a></div><div id="menu"><ul><li><a href=1>Taxes</a></li></ul></div><div id="main"><h1>Waste collection</h1><p>Bins are emptied on Fridays.</p><p>Put them out by six in the morning.</p></div><div class="footer">City hall, Market square 1</div></form>',
        ["Waste collection", "Bins are emptied on Fridays.", "Put them out by six in the morning."],
    ),
    "newsletter form in the article": (
        '<article><h1>Soup</h1><p>Cut the onions and fry them until they are brown.</p><form class="newsletter-signup"><h3>Get recipes by mail</h3><p>One a week, no spam.</p><input><button>Sign up</button></form><p>Add water and boil for an hour.</p></article>',
        ["Soup", "Cut the onions and fry them until they are brown.", "Add water and boil for an hour."],
    ),
    "related articles as articles": (
        '<main><article><h1>Comet seen</h1><p>Observers in Chile saw a new comet last night.</p><p>It will be brightest in March.</p></article><section class="related-stories"><h2>More</h2><article><h3><a href=1>Moon landing</a></h3><p>A probe has landed.</p></article><article><h3><a href=2>Mars dust</a></h3><p>A storm grows.</p></article></section></main>',
        ["Comet seen", "Observers in Chile saw a new comet last night.", "It will be brightest in March."],
    ),
    "list of links in the article": (
        "<nav><a href=/>Docs</a></nav><article><h1>Guides</h1><p>These guides are for new users:</p><ul><li><a href=a>Install it</a> on any system</li><li><a href=b>First steps</a> after that</li></ul><p>Ask if you are stuck.</p></article>",
        ["Guides", "These guides are for new users:", "Install it on any system", "First steps after that", "Ask if you are stuck."],
    ),
    "figure, quotation, code": (
        '<div class="post"><h1>Sorting</h1><p>Here is how to sort a list.</p><pre>x = sorted(y)</pre><figure><img src=a.png alt=no><figcaption>A sorted list.</figcaption></figure><blockquote><p>Sort early, sort often.</p></blockquote><p>That is all.</p></div><div class="sidebar"><h3>Tags</h3><a href=1>lists</a></div>',
        ["Sorting", "Here is how to sort a list.", "x = sorted(y)", "A sorted list.", "Sort early, sort often.", "That is all."],
    ),
    "text in a content div with line breaks": (
        '<div class="navbar"><a href=1>One</a> | <a href=2>Two</a></div><div class="article-body">The mill was built in 1820.<br><br>It burnt down in 1904 and was never rebuilt.</div><div id="footer">Webmaster</div>',
        ["The mill was built in 1820. It burnt down in 1904 and was never rebuilt."],
    ),
    "definition list and table": (
        "<main><h1>Units</h1><dl><dt>Metre<dd>A length.<dt>Second<dd>A time.</dl><table><tr><th>Unit<th>Sign<tr><td>Metre<td>m</table></main><aside><p>Sponsored by rulers. Buy one today, they are good.</p></aside>",
        ["Units", "Metre", "A length.", "Second", "A time.", "Unit", "Sign", "Metre", "m"],
    ),
    "hidden text": (
        '<article><h1>Visible</h1><p>This can be seen by all readers.</p><div style="display: none"><p>This cannot be seen at all.</p></div><p hidden>Nor this one.</p><p>The end of the page.</p></article>',
        ["Visible", "This can be seen by all readers.", "The end of the page."],
    ),
    "comments inside the article": (
        '<article><h1>Chess opening</h1><p>White moves the king\'s pawn two squares.</p><p>Black has several replies to this.</p><div class="comments"><p>I always play the French.</p><p>Me too, since years.</p></div></article><footer><p>All rights reserved.</p></footer>',
        ["Chess opening", "White moves the king's pawn two squares.", "Black has several replies to this."],
    ),
    "share bar and author": (
        '<main><h1>Snow in April</h1><div class="social-share"><a href=1>Post</a> <a href=2>Mail</a></div><p>Late snow fell on the blossom in the whole valley.</p><p>Growers fear for the apples.</p><div class="author-bio"><h4>Jo Writer</h4><p>Jo writes about weather and farms.</p></div></main>',
        ["Snow in April", "Late snow fell on the blossom in the whole valley.", "Growers fear for the apples."],
    ),
    "breadcrumbs and paging": (
        '<div class="breadcrumbs"><a href=/>Home</a> &gt; <a href=/a>Animals</a></div><div id="content"><h1>The otter</h1><p>Otters live by rivers and eat fish.</p></div><div class="pagination"><a href=1>Previous</a> <a href=2>Next</a></div>',
        ["The otter", "Otters live by rivers and eat fish."],
    ),
    "sections": (
        "<header><h1>Site name</h1><p>All about trees</p></header><article><h1>Oaks</h1><section><h2>Leaves</h2><p>They are lobed.</p></section><section><h2>Wood</h2><p>It is hard, and used for ships and barrels.</p></section></article><footer><p>Trees online. Write to us at any time.</p></footer>",
        ["Oaks", "Leaves", "They are lobed.", "Wood", "It is hard, and used for ships and barrels."],
    ),
    "character references and unclosed tags": (
        "<nav>x</nav><article><h1>A &amp; B<p>One &lt;tag&gt; here, caf&eacute; &#8212; fine.<p>Two\n\n  <b>bold<br>words.<script>no()</script></article>",
        ["A & B", "One <tag> here, café — fine.", "Two bold words."],
    ),
    "names that say nothing": (
        '<body><div id="top">Harbour Weekly</div><div id="col1"><a href=1>One</a> <a href=2>Two</a></div><div id="col2"><h1>The old crane</h1><p>The crane at the harbour is to be taken down this summer.</p><p>It was built in 1911 and has not moved since the war.</p></div><div id="bot">Harbour Weekly, Pier 3, all enquiries by post</div></body>',
        ["The old crane", "The crane at the harbour is to be taken down this summer.", "It was built in 1911 and has not moved since the war."],
    ),
    "numbered parts": (
        '<body><div class="x1"><a href="/">Kite club</a></div><div class="x2"><ul><li><a href=1>Events</a></li><li><a href=2>Members</a></li><li><a href=3>Shop</a></li></ul></div><div class="x3"><h2>How to fly in light wind</h2><p>Choose a large kite with a short tail. Walk backwards slowly and let out line.</p><p>When the wind picks up, stop walking.</p><ul><li>Never fly near power lines</li><li>Wear gloves</li></ul></div><div class="x4">Kite club since 1987</div></body>',
        ["How to fly in light wind", "Choose a large kite with a short tail. Walk backwards slowly and let out line.", "When the wind picks up, stop walking.", "Never fly near power lines", "Wear gloves"],
    ),
    "a table whose cells have no names": (
        '<table><tr><td width=120><a href=1>Home</a><br><a href=2>Maps</a><br><a href=3>Guest rooms</a></td><td><h1>Walking to the lake</h1><p>The path begins behind the church and climbs through the wood for an hour.</p><p>Take water with you, as there is none on the way.</p></td></tr><tr><td colspan=2>Tourist office, Main street 4</td></tr></table>',
        ["Walking to the lake", "The path begins behind the church and climbs through the wood for an hour.", "Take water with you, as there is none on the way."],
    ),
    "a line under the text": (
        '<div class="article"><h1>Ferry delayed</h1><p>The evening ferry was two hours late on Friday because of fog.</p><div class="entry-utility">Filed under News</div></div>',
        ["Ferry delayed", "The evening ferry was two hours late on Friday because of fog."],
    ),
    "lines under the title and the text": (
        '<article><h1>Ferry delayed</h1><div class="k9">News desk, 4 May</div><p>The evening ferry was two hours late on Friday because of fog.</p><p>Nobody was hurt.</p><div class="k7">Filed under News</div></article>',
        ["Ferry delayed", "The evening ferry was two hours late on Friday because of fog.", "Nobody was hurt."],
    ),
    "links to other articles at the end": (
        '<div class="article"><h1>Bees return</h1><p>The hives on the roof of the town hall are full again after the winter.</p><p>The keeper expects ten jars of honey.</p><h3>Related stories</h3><ul><li><a href=1>Wasps in the attic</a></li><li><a href=2>Ants on the march</a></li></ul></div>',
        ["Bees return", "The hives on the roof of the town hall are full again after the winter.", "The keeper expects ten jars of honey."],
    ),
    "links under a bold line at the end": (
        '<nav><a href=/>Home</a></nav><article><h1>Bees return</h1><p>The hives are full again.</p><h2>What they eat</h2><p>Clover, lime and sycamore.</p><p><b>Read next</b></p><ul><li><a href=1>Wasps in the attic</a></li><li><a href=2>Ants on the march</a></li><li><a href=3>Flies</a></li></ul></article><footer>Town news</footer>',
        ["Bees return", "The hives are full again.", "What they eat", "Clover, lime and sycamore."],
    ),
    "a list of links that is the article": (
        '<div class="q"><h1>Sources</h1><p>This list names the books that were used for the course, by year:</p><ul><li><a href=1>Maps of 1820</a></li><li><a href=2>Letters of 1830</a></li></ul></div>',
        ["Sources", "This list names the books that were used for the course, by year:", "Maps of 1820", "Letters of 1830"],
    ),
    "two columns, text on the left": (
        '<div id="p"><div id="p1"><a href="/">Garden notes</a></div><div id="p2"><h2>Pruning roses</h2><p>Cut above a bud that points outwards, with a slope away from it.</p><p>Old wood goes first. Burn what is diseased.</p></div><div id="p3"><h3>Older notes</h3><ul><li><a href=1>Mulch</a></li><li><a href=2>Slugs</a></li></ul></div><div id="p4">Garden notes 2011</div></div>',
        ["Pruning roses", "Cut above a bud that points outwards, with a slope away from it.", "Old wood goes first. Burn what is diseased."],
    ),
    "a title in a div of its own": (
        '<div class="r1"><a href=1>Start</a> | <a href=2>Archive</a></div><div class="r2"><div class="r3">The night train</div><p>It leaves at ten and arrives before breakfast, if all goes well.</p><p>The beds are short. Bring earplugs, or a good book.</p></div>',
        ["The night train", "It leaves at ten and arrives before breakfast, if all goes well.", "The beds are short. Bring earplugs, or a good book."],
    ),
    "two sections without names": (
        '<div><a href=/>Chess club</a></div><div><section><h2>Openings</h2><p>The first moves decide who holds the middle of the board.</p></section><section><h2>Endings</h2><p>With few pieces left the king comes out and fights.</p></section></div><div>Chess club, room 12</div>',
        ["Openings", "The first moves decide who holds the middle of the board.", "Endings", "With few pieces left the king comes out and fights."],
    ),
    "a link list in the middle": (
        '<article><h1>Tools</h1><p>You need three of them, all of which are sold online:</p><ul><li><a href=1>A saw</a></li><li><a href=2>A plane</a></li></ul><p>Sharpen both before use.</p></article>',
        ["Tools", "You need three of them, all of which are sold online:", "A saw", "A plane", "Sharpen both before use."],
    ),
    "nothing but a menu": ("<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><footer>&copy; us</footer>", []),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_text_of_hand_written_pages(name):
    page, want = LAYOUTS[name]
    assert main_text(page, default_chain()) == "\n\n".join(want)


def test_deep_nesting_takes_time_in_proportion():
    deep = "<div>a b c. " * 20_000
    assert len(html_blocks.blocks(deep)) == 20_000
    assert "The end." in main_text(f"<article><p>First words here.</p>{'<div>' * 20_000}<p>The end.</p></article>", default_chain())


def test_chain_on_other_pages_of_the_generator():
    wrong = total = 0
    for p in html_extract.labelled_pages(200, seed=77):
        label = default_chain().decode([b.features for b in html_blocks.blocks(p.replace(html_extract._MARK, ""))])
        want = [int(html_extract._MARK in b.text) for b in html_blocks.blocks(p)]
        wrong, total = wrong + sum(a != b for a, b in zip(label, want)), total + len(want)
    assert wrong / total < 0.01


def score(chain, features, labels):
    steps = sum(chain.steps[a][b] for a, b in zip(labels, labels[1:]))
    return steps + sum(chain.weights[f] for x, y in zip(features, labels) if y for f in x)


def test_viterbi_finds_the_best_of_all_labellings():
    r = np.random.default_rng(3)
    for n in [0, 1, 2, 5, 9] * 8:
        chain = Chain(r.normal(size=6), r.normal(size=(2, 2)))
        features = [[int(f) for f in np.flatnonzero(r.random(6) < 0.5)] for _ in range(n)]
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: score(chain, features, y))
        assert abs(score(chain, features, chain.decode(features)) - score(chain, features, best)) < 1e-9


def test_likelihood_and_gradient():
    """The likelihood by enumeration, the gradient by differences."""
    r = np.random.default_rng(4)
    pages = [p for p in html_extract.labelled_pages(90, seed=9) if 1 < len(html_blocks.blocks(p)) < 9][:6]
    x, y, at = html_extract.examples(pages)
    w, s = r.normal(size=x.shape[1]) / 5, r.normal(size=(2, 2))
    want = 0.0
    for first in range(len(at[0])):
        rows = [here[first] for here in at if first < len(here)]
        features = [np.flatnonzero(x[i]).tolist() for i in rows]
        total = [score(Chain(w, s), features, labels) for labels in itertools.product((0, 1), repeat=len(rows))]
        want += score(Chain(w, s), features, [int(y[i]) for i in rows]) - np.logaddexp.reduce(total)
    value, gw, gs = html_extract.gradient(w, s, x, y, at)
    assert len(pages) == 6 and abs(value - want) < 1e-8
    for p, g in ((w, gw), (s, gs)):
        for i in np.ndindex(p.shape):
            p[i] += 1e-5
            up = html_extract.gradient(w, s, x, y, at)[0]
            p[i] -= 2e-5
            down = html_extract.gradient(w, s, x, y, at)[0]
            p[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-5
