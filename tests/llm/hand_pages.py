"""Pages written and labelled by hand: main text stands between ⟦ and ⟧, one pair for each block.

They follow how kinds of sites are commonly built, not the generator that the labeller is trained on.
"""

NEWS = """<!doctype html><html><head><title>Ferry service resumes | The Coast Gazette</title></head><body class="home news">
<a class="skip" href="#m">Skip to content</a>
<div id="masthead"><div class="brand"><a href="/">The Coast Gazette</a></div><ul class="primary"><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul></div>
<div class="breaking-ticker"><a href="/l1">Live: council votes tonight</a></div>
<div id="m" class="story-wrap"><article class="story">
<h1>⟦Ferry service resumes after three weeks of repairs⟧</h1>
<p class="standfirst">⟦Engineers replaced both engines, and the harbour authority says that timetables return to normal on Monday.⟧</p>
<div class="share-tools"><a href="#">Share</a> <a href="#">Tweet</a> <a href="#">Email</a></div>
<p>⟦The ferry that links the island with the mainland sailed again on Friday, three weeks after a fire in its engine room put it out of service.⟧</p>
<p>⟦Passengers queued from six in the morning. “I have missed my daughter's school play because of this,” said one of them, who works at the fish market.⟧</p>
<aside class="pullout"><h4>More on this</h4><ul><li><a href="/s1">Fire on board: what we know</a></li><li><a href="/s2">Island shops run low on bread</a></li></ul></aside>
<h2>⟦What went wrong⟧</h2>
<p>⟦An inquiry found that a fuel line had cracked. The line had been inspected in spring, but the report of that inspection was never read.⟧</p>
<div class="ad-unit" id="ad-mid"><span>Advertisement</span><p>Sail in style: cruises from 499.</p></div>
<p>⟦The authority has promised to publish all reports from now on.⟧</p>
</article>
<section id="responses"><h3>Readers' comments (2)</h3><div class="comment-item"><b>Marlin</b><p>About time. They should have had a spare boat for years now.</p></div><div class="comment-item"><b>Gull</b><p>Well written piece, thanks.</p></div></section></div>
<div class="rail"><h3>Most read</h3><ol><li><a href="/m1">Lighthouse for sale</a></li><li><a href="/m2">Storm names announced</a></li></ol></div>
<div id="foot"><p>© The Coast Gazette 2021. Registered office: 1 Quay Street.</p><a href="/privacy">Privacy</a> <a href="/terms">Terms</a></div>
</body></html>"""

WIKI = """<html><body><div id="mw-page-base"></div><div id="mw-panel"><div role="navigation"><h3>Navigation</h3><ul><li><a href="/wiki/Main">Main page</a></li><li><a href="/wiki/Random">Random article</a></li></ul></div></div>
<main id="content" class="mw-body"><h1 id="firstHeading">⟦Tidal island⟧</h1><div id="bodyContent"><div class="mw-parser-output">
<p>⟦A tidal island is a piece of land that is connected to the mainland by a causeway which is covered at high tide and exposed at low tide.⟧</p>
<table class="wikitable"><tr><th>⟦Island⟧</th><th>⟦Country⟧</th></tr><tr><td>⟦Lindisfarne⟧</td><td>⟦England⟧</td></tr><tr><td>⟦Noirmoutier⟧</td><td>⟦France⟧</td></tr></table>
<h2>⟦Formation⟧</h2><p>⟦Causeways may be natural or built. Natural ones form where currents from both sides of an island meet and drop their sand.⟧</p>
<ul><li>⟦Some are passable for a few hours only.⟧</li><li>⟦Others fall dry for days around neap tides.⟧</li></ul>
</div></div></main>
<footer id="footer"><ul><li>This page was last edited on 3 May.</li><li>Text is available under a free licence; additional terms may apply.</li></ul></footer></body></html>"""

DOCS = """<html><body><header><a href="/">libtide</a><form role="search"><input name="q" placeholder="Search docs"><button>Go</button></form></header>
<div class="layout"><nav aria-label="Docs"><ul><li><a href="/install">Installation</a></li><li><a href="/api">API reference</a></li><li><a href="/faq">FAQ</a></li></ul></nav>
<main><div class="doc prose"><h1>⟦Installation⟧</h1><p>⟦The package needs a compiler and version 3 of the headers.⟧</p>
<pre><code>⟦tide install --with-headers⟧</code></pre><p>⟦To check that it works, run the program with no arguments: it prints the next high water for the port in your settings.⟧</p>
<h2>⟦Building from source⟧</h2><ol><li>⟦Fetch the archive and unpack it.⟧</li><li>⟦Run the configure script.⟧</li></ol>
<blockquote><p>⟦Building on small machines can take an hour.⟧</p></blockquote></div>
<div class="pagination-nav"><a href="/prev">Previous: Overview</a><a href="/next">Next: Settings</a></div></main>
<aside class="toc"><p>On this page</p><ul><li><a href="#a">Building from source</a></li></ul></aside></div>
<footer><p>Released under a free licence.</p></footer></body></html>"""

BLOG = """<html><body><div class="wrap"><div class="hdr"><a href="/">Notes from a small boat</a><div class="tagline">sailing, slowly</div></div>
<div class="cookie-bar">This site uses cookies. <button>OK</button></div>
<div class="td-post-content"><h2>⟦A week at anchor⟧</h2>
⟦We dropped the anchor on Sunday and did not lift it until the Sunday after. It rained for most of that time.⟧<br><br>
<p>⟦On the third day the children had read all the books on board, and we began to make up stories of our own.⟧</p>
<div>⟦Someone always has to be the whale.⟧</div>
<figure><img src="x.jpg"><figcaption>⟦The bay in the rain⟧</figcaption></figure>
<p>⟦If you ever find yourself there: the bakery opens at seven, and sells out by eight.⟧</p></div>
<div class="author-bio"><p>Rowan lives on a boat and writes about it.</p></div>
<div class="newsletter-signup"><h3>Get new posts by mail</h3><form><input type="email"><button>Subscribe</button></form></div>
<div class="related-posts"><h3>You may also like</h3><a href="/1">Fixing a mast with string</a><a href="/2">Fog, and how to sit it out</a></div>
<div id="disqus_thread"><p>Lovely post, we were there last June!</p><p>The bakery has closed, sadly.</p></div></div>
<div class="site-info">Powered by a blog engine. All rights reserved.</div></body></html>"""

FORUM = """<html><body><div id="page-header"><div class="headerbar"><h1><a href="/">Anchor talk</a></h1><p>A board for people with boats</p></div><ul class="linklist"><li><a href="/login">Login</a></li><li><a href="/register">Register</a></li></ul></div>
<div id="page-body"><main class="topic"><h2 class="topic-title">⟦How much chain for ten metres of water?⟧</h2>
<article class="question post-text"><p>⟦I have thirty metres of chain and a boat of nine metres. The bay that I want to stay in has ten metres of water at high tide, with mud at the bottom.⟧</p><p>⟦Is that enough for a night with a moderate wind, or should I add rope?⟧</p></article></main>
<div class="sidebar widget"><h3>Recent topics</h3><ul><li><a href="/t/1">Bilge pump hums</a></li><li><a href="/t/2">Which varnish?</a></li></ul></div></div>
<div id="page-footer" class="navbar"><ul><li><a href="/contact">Contact us</a></li></ul><div class="copyright">Board software by volunteers.</div></div></body></html>"""

TABLES = """<html><body bgcolor=white><table width=100% border=0><tr><td colspan=2 class="top"><img src=logo.gif alt=logo> <a href=/>Home</a> | <a href=/map>Site map</a></td></tr>
<tr><td width=150 valign=top class="menu"><a href=/a>Tides</a><br><a href=/b>Currents</a><br><a href=/c>Charts</a></td>
<td valign=top class="content"><h1>⟦Reading a tide table⟧</h1><p>⟦Find your port, or the nearest standard port, in the list.⟧<p>⟦Add one hour in summer. The heights are above chart datum, which is the lowest tide that is expected from the moon and the sun alone.⟧
<table><tr><td>⟦Time⟧<td>⟦Height⟧<tr><td>⟦04:12⟧<td>⟦5.1 m⟧</table>
<p>⟦A low barometer lifts the sea by about a centimetre for each millibar.⟧</td></tr>
<tr><td colspan=2 class="bottom"><font size=1>Page maintained by the harbour office. Best viewed at 800 by 600.</font></td></tr></table></body></html>"""

PRESS = """<html><body><header class="global"><nav><a href="/">Harbour Works plc</a><a href="/investors">Investors</a><a href="/careers">Careers</a></nav></header>
<section class="hero"><div class="release-body"><h1>⟦Harbour Works opens new slipway⟧</h1><p class="dateline">⟦Port Haven, 4 June: Harbour Works today opened a slipway for vessels of up to forty metres.⟧</p>
<p>⟦The slipway took two years to build and employed sixty people.⟧</p><p>⟦“We are glad to be able to repair local boats locally,” said the yard's manager.⟧</p>
<h3>⟦About Harbour Works⟧</h3><p>⟦Harbour Works has repaired boats since 1911.⟧</p></div></section>
<div class="modal" role="dialog"><h2>Your privacy</h2><p>We value your privacy. Choose which trackers to allow.</p><button>Accept all</button></div>
<section class="contact-form"><h3>Ask the press office</h3><form><label>Name</label><input><label>Message</label><textarea>hello</textarea><button>Send</button></form></section>
<footer><div class="cols"><a href="/imprint">Imprint</a><a href="/cookies">Cookies</a></div><small>Copyright Harbour Works plc</small></footer></body></html>"""

RECIPE = """<html><body><div class="top-nav"><a href="/">Galley food</a><a href="/soups">Soups</a><a href="/bread">Bread</a></div>
<div class="recipe-card entry-content"><h1>⟦Mussel soup for two⟧</h1><p>⟦Takes half an hour and one pot, which is all that most galleys have room for.⟧</p>
<div class="sponsored-box"><p>Try our partner's pans, now 20 % off!</p></div>
<h2>⟦Ingredients⟧</h2><ul class="ingredients"><li>⟦1 kg mussels⟧</li><li>⟦2 onions⟧</li><li>⟦a glass of white wine⟧</li></ul>
<h2>⟦Method⟧</h2><ol><li>⟦Scrub the mussels and throw away those that stay open.⟧</li><li>⟦Soften the onions, add the wine and the mussels, and cover the pot for five minutes.⟧</li></ol></div>
<div class="ratings-and-reviews"><h3>Reviews</h3><p>Made this twice, five stars!</p></div>
<div class="tag-cloud"><a href="/t/soup">soup</a><a href="/t/sea">sea</a></div><footer>Galley food, made with care.</footer></body></html>"""

PAGES = {"news": NEWS, "wiki": WIKI, "docs": DOCS, "blog": BLOG, "forum": FORUM, "tables": TABLES, "press": PRESS, "recipe": RECIPE}


def labelled(page: str) -> tuple[str, list[str]]:
    """The page as a site would send it, and its main text."""
    parts = page.split("⟦")
    return page.replace("⟦", "").replace("⟧", ""), [p.split("⟧")[0] for p in parts[1:]]
