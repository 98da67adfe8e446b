"""Labelled pages from which html_extract learns its weights. An element with the attribute keep holds main text;
text inside an element with the attribute drop, or outside any keep, is not main text."""

PAGES = [
    """<html><head><title>Tides</title><style>p{}</style></head><body><header><a href="/">The Coast Review</a></header>
<nav><ul><li><a href="/n">News</a></li><li><a href="/s">Science</a></li><li><a href="/m">More</a></li></ul></nav>
<article keep><h1>Why tides differ</h1><p>The moon pulls the near side of the sea more than the far side.</p>
<p>Bays and shelves then shape what arrives at the shore, so that two harbours may see <b>very</b> different tides.</p></article>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Storm warning</a></li><li><a href="/2">New pier</a></li></ul></aside>
<footer>&copy; 2020 The Coast Review. All rights reserved.</footer></body></html>""",
    """<html><body><div id="header" class="site-header"><div class="logo">Cookery</div><div class="menu"><a href="/a">Soups</a> <a href="/b">Bread</a> <a href="/c">Cakes</a></div></div>
<div class="breadcrumb"><a href="/">Home</a> <a href="/b">Bread</a></div>
<div id="content" class="content" keep><h2>A loaf in an afternoon</h2><p>Mix flour, water, salt and yeast and leave the dough to rise.</p>
<ul><li>Five hundred grams of flour</li><li>Three hundred grams of water</li></ul>
<div class="ad advert" drop>Buy our knives now, this week only.</div><p>Bake it until the crust is dark and sounds hollow.</p></div>
<div class="related"><h3>Related posts</h3><a href="/x">Rye</a> <a href="/y">Oats</a></div>
<div id="comments" class="comments"><h3>Comments</h3><div class="comment"><p>I tried it twice and my family loved the result.</p></div><div class="comment"><p>Mine was too wet, what did I do wrong?</p></div>
<form class="comment-form"><label>Your name</label><input><textarea></textarea></form></div>
<div class="footer" id="footer"><p>Contact and imprint</p></div></body></html>""",
    """<html><body><div class="cookie-notice banner" role="alert"><p>We use cookies to improve your visit. Accept all or choose settings.</p></div>
<nav class="navbar" role="navigation"><a href="/">Start</a><a href="/p">Prices</a><a href="/l">Log in</a></nav>
<main role="main" keep><section class="post entry"><header><h1>Release notes</h1><p>What is new in this version for people who read files</p></header><p>This version reads larger files and writes fewer small ones.</p>
<pre>open the file and read it line by line</pre><blockquote>It now takes half the time.</blockquote>
<table><tr><th>Size</th><th>Time</th></tr><tr><td>One</td><td>Two</td></tr></table></section></main>
<section class="newsletter subscribe" drop><form action="/s"><p>Sign up for our newsletter to hear of new versions.</p><input><label>Mail address</label></form></section>
<div class="social share"><a href="/f">Share</a><a href="/t">Tweet</a></div><footer class="site-footer"><ul><li><a href="/i">Imprint</a></li><li><a href="/d">Privacy policy</a></li></ul></footer></body></html>""",
    """<html><body><!-- ad 7 --><div class="ad">A better mattress for less money than you think.</div>
<div class="article-body story" keep><h1>Council votes on the bridge</h1><p class="byline">By our reporter</p><p>The council agreed on Tuesday to repair the old bridge.<br>Work starts in spring.</p>
<figure><figcaption>The bridge in winter</figcaption></figure><p>Traffic will use the ferry for the time being.</p></div>
<div class="ads sponsored promo"><p>Sponsored: holidays at the lake for the whole family.</p></div>
<div class="user-comments discussion"><ul><li class="reply"><p>About time that somebody repaired it at last!</p></li></ul></div>
<footer><p>&copy; Local Paper &middot; Terms of use</p></footer></body></html>""",
    """<html><body><ul class="nav menu"><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul><header><h2>My notes</h2><p>Thoughts on this and that</p></header>
<div class="wrapper"><div class="post-content text" keep><p>Last week I walked from one end of the valley to the other.</p><p>It rained for most of the way, yet I would go again.</p><h2>What I took</h2><ol><li>A coat</li><li>Too much food</li></ol></div>
<div class="widget right-column"><h4>Archive</h4><a href="/1">May</a><a href="/2">June</a><form class="search"><input><label>Search this site</label></form></div></div>
<div class="responses" id="respond"><h3>Two replies</h3><p>Lovely walk, thank you for writing it down.</p></div><div class="disclaimer notice"><p>All opinions are my own.</p></div><footer>Written by hand</footer></body></html>""",
    """<html><body><div class="popup modal"><p>Subscribe today and save half of the price.</p></div><div class="topbar"><a href="/l">Sign in</a></div>
<div itemprop="articleBody" class="body" keep><p>Glass is made from sand, soda and lime at great heat.</p><p>Slow cooling keeps it from breaking.</p></div>
<aside><h3>Advertisement</h3><p>Windows at factory prices.</p></aside><div class="legal copyright"><p>Reproduction needs our permission.</p></div></body></html>""",
    """<html><body class="site page"><div class="site-header header"><h1>The garden page</h1></div><div class="site-content page-wrapper row column right user-content widget-area" keep><h3>Pruning in March</h3>
<p>Cut roses back to a bud that looks outwards and take away all the dead wood you can find.</p><h4>Tools</h4><p>A sharp knife and a saw will do for nearly everything in a small garden.</p></div>
<div class="comment-list"><p>My roses never came back after that, sadly.</p></div><div class="site-footer">Made at home</div></body></html>""",
    """<html><body><div role="banner"><a href="/">The observer</a> All that is new in town</div><div role="navigation"><a href="/1">One</a></div>
<div role="main" class="container" keep><p>The library opens again after a long winter of repairs to its roof.</p><p>Readers will find the old tables and quite a few new lamps.</p></div>
<div role="complementary" class="sponsor sponsors"><p>Popular this week: the list of lists, and a word from those who pay for it.</p></div>
<div class="tags tag-list"><p>Filed under: libraries, winter, roofs, tables and lamps</p></div><div class="pagination pager"><a href="/2">Next page</a> of many more pages to come</div>
<div class="author-bio about-author"><p>She writes about books and about the people who read them.</p></div><div role="contentinfo"><p>Address and telephone number of the office in town</p></div>
<div role="search"><form><label>Find in all issues of the paper</label></form></div></body></html>""",
    """<html><body><div class="toc sidebar-nav"><p>On this page: first part, second part, sources and notes</p></div><div class="page-content author-text about" keep><p>A lamp needs oil, a wick and somebody who remembers to light it.</p>
<p>Most of all it needs a room that would be dark without it.</p></div><div class="skip-link skip"><a href="#c">Skip to the content of this page</a></div><div class="login signup account"><p>Log in or make an account to read on.</p></div>
<div class="feedback survey rating"><p>Was this page of any help to you? Tell us.</p></div><div class="print-only consent gdpr"><p>We and our partners store data on your device.</p></div></body></html>""",
    """<html><body class="has-sidebar no-ads"><div class="x1"><div class="x2"><a href="/">Ferry times</a></div><div class="x3"><a href="/1">Lines</a> <a href="/2">Fares</a> <a href="/3">Piers</a></div></div>
<div class="x4" keep><h1>A new boat for the island</h1><p>The yard handed over the boat on Monday after two years of work on its hull and engines.</p><p>It carries forty cars, and <a href="/e">its engine</a> makes less noise than that of the old one.</p>
<p>The first crossing leaves at six in the morning.</p></div><div class="x5"><p>Related stories</p><p><a href="/7">The pier is closed in winter</a></p><p><a href="/8">Why the sea is cold in May</a></p></div>
<div class="x6"><p>Subscribe to our newsletter and get the news of the harbour in your inbox.</p></div><div class="x7">Copyright 2019 Ferry times. All rights reserved. Privacy policy</div></body></html>""",
    """<html><body><div id="a"><p>We use cookies to make this site work. Accept cookies or change your cookie settings.</p></div><div id="b"><div><h2>How to mend a wall of stones</h2>
<div keep><p>Lay the largest stones at the bottom, with their long sides into the wall, and fill the heart with small ones.</p><p>Every third course put in a stone that goes through the whole wall.</p></div>
<p>Sponsored: order now and save 20 % off all our tools.</p><div><a href="/t">Tools</a>, <a href="/s">Stones</a>, <a href="/w">Walls</a></div></div><div><p>3 comments</p><p>Ann says: mine fell down.</p><p>Bob wrote: use larger stones then.</p><p>Leave a comment</p></div></div>
<div id="c"><p>Share this on your page. Follow us. Log in to your account.</p><p>Back to top</p><p>&copy; 2021 by the mason</p></div></body></html>""",
    """<html><body><div class="wp-site-blocks"><article class="hentry post type-post category-rivers" keep><header class="entry-header" keep><h1 class="entry-title">Otters</h1></header><div class="entry-content" keep><p>Otters came back to the river when its water became clean, and now eat most of its eels.</p>
<aside class="pullquote" keep><p>They sleep under the roots of old trees.</p></aside><div class="wp-block-button" drop>Buy now</div></div><footer class="entry-footer" drop><span class="cat-links">Filed under: <a href="/r">Rivers</a></span> <span class="tags-links">Tags: <a href="/o">otters</a></span></footer></article>
<div class="post-navigation"><a href="/p">Previous page</a> <a href="/n">Next page</a></div><section id="comments" class="comments-area"><article class="comment"><p>I saw one last night at the bridge, it was huge.</p></article></section></div></body></html>""",
    """<html><body><div class="s-header"><div class="s-logo">Star charts</div></div><div class="s-wrap"><div class="article__content story-body" keep><p>Two planets stand close to each other in the west this evening.</p><figure class="article__image"><figcaption>Both as seen from the hill</figcaption></figure><p>By midnight both are gone.</p></div>
<div class="article__share share-bar">Share via mail</div><div class="article__tags">Tags: planets, evening</div><div class="recommendations recommended-articles"><h4>You may also like</h4><p>The moon and how to look at it with the naked eye</p></div><div class="paywall-banner"><p>Start your free trial to read more of us each week.</p></div></div>
<div class="s-footer"><div class="footer-links"><a href="/a">About</a></div><div class="footer__legal">Terms of use</div></div></body></html>""",
    """<html><body><table><tr><td><a href="/1">Index</a><br><a href="/2">Maps</a><br><a href="/3">Guest book</a></td><td keep><h2>Castles of the north</h2><p>The oldest of them stands on a rock above the mouth of the river and was built in four years.</p><p>Its hall is open in summer; the tower is not.</p></td></tr>
<tr><td>Last changed in May. Copyright by the author.</td></tr></table></body></html>""",
    """<html><body><div class="layout"><div class="sidebar-left nav-list"><ul><li><a href="/i">Install</a></li><li><a href="/u">Use</a></li></ul></div><div role="article" class="doc-body markdown-body" keep><h1>Reading a table</h1><p>Call the function with the name of the file; it returns a table.</p><pre>t = read("a.csv")</pre><p>Rows that are broken are left out.</p></div>
<div class="on-page-toc toc"><p>On this page</p><a href="#1">Reading</a></div></div><div class="feedback-form"><p>Was this helpful? Send us a message.</p></div></body></html>""",
]
