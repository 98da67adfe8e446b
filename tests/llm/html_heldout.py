"""Pages of unlike site templates, which html_extract does not learn from, with their main texts (blocks)."""

PAGES = {
    "blog with sidebar": (
        """<!DOCTYPE html><html><head><title>T</title></head><body class="home blog has-sidebar no-ads"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><p class="site-title">Orchard notes</p><nav class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav></header>
<div id="primary" class="content-area"><article id="post-7" class="post-7 post social-science"><header class="entry-header"><h1 class="entry-title">Grafting an old apple</h1></header><div class="entry-content"><p>Cut the scion in late winter and keep it cool until the sap rises in the stock.</p><p>Bind the joint well and seal it with wax, then wait until May.</p></div></article></div>
<div id="secondary" class="widget-area"><aside class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Pears in pots</a></li></ul></aside></div><footer id="colophon" class="site-footer"><div class="site-info">Proudly made with care</div></footer></div></body></html>""",
        ["Grafting an old apple", "Cut the scion in late winter and keep it cool until the sap rises in the stock.", "Bind the joint well and seal it with wax, then wait until May."],
    ),
    "misleading wrapper": (
        """<body><div data-role="footer" class="layout-3"><article class="post"><p>A page may stand in boxes with strange attributes and still be read by people.</p><p>The words are what counts for them.</p></article></div><div class="copy">copyright 2020 The Box Review, all rights reserved</div></body>""",
        ["A page may stand in boxes with strange attributes and still be read by people.", "The words are what counts for them."],
    ),
    "icons": (
        """<body><div class="topnav"><svg class="i"/><a href="/">Start</a></div><main><h1>Snow in April</h1><svg/><p>It snowed for two days and the buds froze on every branch of the cherry trees.</p><p>Farmers lit fires between the rows at night.</p></main><div class="bottom"><svg/>&copy; 2022</div></body>""",
        ["Snow in April", "It snowed for two days and the buds froze on every branch of the cherry trees.", "Farmers lit fires between the rows at night."],
    ),
    "news with paywall": (
        """<html><body><div class="masthead__wrap"><a href="/">The Valley Post</a></div><div class="gdpr-banner"><p>We and our partners use cookies to measure visits. Accept all cookies?</p></div><div class="l-main"><div class="story__body"><h1>Mill to reopen</h1><p class="lede">The old mill above the town opens again in autumn, its new owner said on Friday.</p>
<div class="ad-slot-2">Advertisement</div><p>Twelve people will work there at first, most of them in the bakery that belongs to it.</p><p>The wheel is being rebuilt by a joiner from the next valley.</p></div><div class="related-stories"><h3>Related stories</h3><ul><li><a href="/x">Bakery closes</a></li><li><a href="/y">Flood of 1910</a></li></ul></div></div>
<div class="newsletter-signup"><p>Sign up and get the news each morning.</p></div><div class="l-footer"><a href="/i">Imprint</a> <a href="/p">Privacy policy</a></div></body></html>""",
        ["Mill to reopen", "The old mill above the town opens again in autumn, its new owner said on Friday.", "Twelve people will work there at first, most of them in the bakery that belongs to it.", "The wheel is being rebuilt by a joiner from the next valley."],
    ),
    "unnamed boxes": (
        """<html><body><div><a href="/">Home</a> | <a href="/b">Boats</a> | <a href="/c">Contact</a></div><div><h1>Rowing upstream</h1><p>Keep close to the bank where the water is slow, and use the eddies behind the stones.</p><p>Where the river bends, cross over early, for the current is strongest on the outside.</p></div>
<div><p>Log in to your account or sign up for the newsletter</p></div><div><p>&copy; 2018 The rowing club. All rights reserved.</p></div></body></html>""",
        ["Rowing upstream", "Keep close to the bank where the water is slow, and use the eddies behind the stones.", "Where the river bends, cross over early, for the current is strongest on the outside."],
    ),
    "comments": (
        """<html><body><div class="container"><div class="blogpost"><h2>My first beehive</h2><p>The bees came in a box by train, and I was afraid of them for about an hour.</p><p>By the end of June there was honey in every frame.</p></div><div class="disqus-thread comments-section"><h4>12 comments</h4><div class="comment-body"><p>What a lovely story, mine swarmed the first week and never came back to me.</p></div><div class="comment-body"><p>Which kind of frame do you use for them?</p></div></div></div></body></html>""",
        ["My first beehive", "The bees came in a box by train, and I was afraid of them for about an hour.", "By the end of June there was honey in every frame."],
    ),
    "handbook": (
        """<html><body><div class="navbar-fixed"><a href="/">Handbook</a><input type="search"></div><div class="grid"><div class="left-nav"><ul><li><a href="/1">Pumps</a></li><li><a href="/2">Valves</a></li><li><a href="/3">Pipes</a></li></ul></div><div class="main-column"><h1>Valves</h1><p>A valve opens or closes the way of the water. Turn it by hand and never with a tool.</p><table><tr><th>Size</th><th>Turns</th></tr><tr><td>Small</td><td>Four</td></tr></table><p>See <a href="/3">pipes</a> for how to join them.</p></div></div><div class="prev-next"><a href="/1">Previous page</a><a href="/3">Next page</a></div></body></html>""",
        ["Valves", "A valve opens or closes the way of the water. Turn it by hand and never with a tool.", "Size", "Turns", "Small", "Four", "See pipes for how to join them."],
    ),
    "old tables": (
        """<html><body bgcolor="white"><table width="100%"><tr><td colspan="2"><b>Museum of clocks</b></td></tr><tr><td><a href="/1">Hours</a><br><a href="/2">Rooms</a><br><a href="/3">Shop</a></td><td><h1>The water clock</h1><p>Water runs from the upper vessel to the lower one, and a float moves the hand.</p><p>It has to be filled twice a day, and in frost it stands still.</p></td></tr></table><p><font size="1">Copyright by the museum. All rights reserved.</font></p></body></html>""",
        ["The water clock", "Water runs from the upper vessel to the lower one, and a float moves the hand.", "It has to be filled twice a day, and in frost it stands still."],
    ),
    "components": (
        """<html><body><div id="root"><div class="Header_wrap__x1Yz"><a href="/">Loom</a></div><div class="ArticleBody_content__k2"><h1>Weaving a border</h1><p>Start with the warp of the border, which is set closer than that of the cloth.</p><p>Change the colour every eight picks; count them aloud.</p></div><div class="PromoCard_box__9a"><p>Shop now: wool at half the price this week.</p></div><div class="Footer_root__q"><p>Made in a small town.</p></div></div></body></html>""",
        ["Weaving a border", "Start with the warp of the border, which is set closer than that of the cloth.", "Change the colour every eight picks; count them aloud."],
    ),
    "wide footer": (
        """<html><body><header role="banner"><a href="/">Weather</a></header><section itemprop="articleBody"><p>Fog forms when moist air cools near the ground during a clear night with little wind.</p><p>It lifts when the sun has warmed the ground enough.</p></section><section class="subscribe-box"><h3>Stay informed</h3><p>Subscribe to the forecast by mail.</p></section><footer><div class="columns"><p>The service has measured rain, wind and warmth at four hundred places for a hundred years and gives its data to all.</p></div></footer></body></html>""",
        ["Fog forms when moist air cools near the ground during a clear night with little wind.", "It lifts when the sun has warmed the ground enough."],
    ),
}
