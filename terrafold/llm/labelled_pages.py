"""A small labelled table: blocks of short pages, kept ones inside an element with ``data-keep``. Training data of the block tree."""

PAGES = (
    """<html><head><title>A day out</title></head><body><header><a href=/>Home of walks</a><p>Walks for all since 1990</p></header>
    <nav><ul><li><a href=/a>Hills</a></li><li><a href=/b>Lakes</a></li><li><a href=/c>Coast</a></li></ul></nav>
    <main data-keep><h1>A day in the hills</h1><p>We left early, when the mist was still on the water and nobody had opened a window.</p>
    <p>Up.</p><p>The path climbs for an hour through old oak and then, without warning, it stops at a wall.</p><h2>Back</h2>
    <p>We came back by <a href=/bus>bus</a>, tired.</p><ul><li>Bring water</li><li>Bring a map and a coat</li></ul></main>
    <aside><h3>Read more</h3><ul><li><a href=/1>Ten short walks for rainy days</a></li><li><a href=/2>What to wear</a></li></ul></aside>
    <footer><p>&copy; 2020 Walks for all. All rights reserved.</p><a href=/imprint>Imprint</a></footer></body></html>""",
    """<body><div class=top-menu><a href=/n>News</a> <a href=/s>Sport</a></div><div class="cookie-notice">We use cookies to make this site
    better and to count visits. <button>Accept</button></div><div class=ad>Buy two pairs of shoes and pay for one, this week only in all shops.</div>
    <article data-keep><h1>Bridge opens</h1><p>The new bridge over the river was opened on Monday by the mayor and a crowd of cyclists.</p>
    <p>It is 90 metres long.</p><p>Yes.</p><p><a href=/plan>Plans of the bridge</a></p><ul><li><a href=/p1>The north tower</a></li><li><a href=/p2>The south tower</a></li></ul><blockquote>We waited for ten years, said one of them.</blockquote></article>
    <div class=sidebar><h3>Most read</h3><p>The old bridge and its history in forty pictures from the archive</p></div>
    <section id=comments><h3>Comments</h3><p>I never thought that I would see the day, well done to everybody involved!</p><p>Too late.</p></section>
    <form><label>Mail</label><input name=m><p>Subscribe to the letter and get all stories every Friday.</p></form><div class=footer>Contact us</div></body>""",
    """<body><ul class=nav><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div data-keep><h1>Soup</h1><p>Cut three onions and let them
    take colour in butter for half an hour, with a little sugar at the end.</p><p>Add stock.</p><table><tr><td>Onions</td><td>3</td></tr></table>
    <p>Serve it hot, with bread and a lot of cheese that has been under the grill.</p></div>
    <div class=promo>Order our cook book today and save ten percent on the price of any other book.</div><p><a href=/x>Back to the list of all recipes</a></p></body>""",
    """<body><header class=site><h2>The Daily Page</h2></header><div id=menu><p>Politics</p><p>Science</p></div>
    <article data-keep><header><h1>Stars</h1><p>By a reader of the sky</p></header><p>On clear nights in August one can count a hundred of them
    in an hour, if one is patient and far from town.</p><p>One can also sleep.</p></article>
    <div class=comment><p>Lovely text, thank you for this, I shall go out tonight with my children.</p></div>
    <div class="newsletter"><p>Get the sky in your mailbox every month, for free, no spam ever.</p></div>
    <footer>The Daily Page, 12 Long Street. Write to us with any question about this site or its use.</footer></body>""",
    """<body><div><a href=/>Start</a> | <a href=/about>About</a> | <a href=/help>Help</a></div><div data-keep><p>Rivers carry sand to the sea and the sea gives
    some of it back in winter storms, which is why the beach of one year is never that of the next.</p><p>In spring the wind takes its share and
    builds the first low dunes behind the line of the tide.</p><p>Grass follows.</p></div>
    <div><a href=/p>Privacy</a> <a href=/t>Terms</a> <a href=/m>Map of this site</a></div></body>""",
    """<body><nav><p>You are here: start, garden, trees</p></nav><div class="banner">Site closed on Sunday for repair, we are sorry for any
    trouble this may cause.</div><article data-keep><h1>Trees</h1><p><b>Plant in autumn.</b> The ground is warm and wet then, and roots grow until the frost.
    </p><p>Water.</p><figure><figcaption>An old pear</figcaption></figure></article><div class=related><a href=/r1>Roses</a><p>More about roses, pruning
    and the right soil for a long summer of flowers</p></div><div class=social><a href=/f>Share</a></div></body>""",
    # Articles that open or close the page, alone or nearly so.
    """<p data-keep>A page may hold one paragraph and nothing else, and then that paragraph is what it has to say.</p>""",
    """<div data-keep>Plain text without any markup around it, as old pages had it.</div>""",
    """<div data-keep><h1>Salt</h1><p>Salt was carried over these hills on mules for six hundred years, and the paths are still there.</p></div>""",
    """<div data-keep><p>The first snow fell in October and stayed.</p><p>Nobody had cut enough wood, so the school closed for a week and the
    children carried logs from the edge of the forest.</p><p>It was a good week.</p></div><div><a href=/1>Older</a> <a href=/2>Newer</a> <a href=/3>All of them</a></div>""",
    """<div><a href=/>Front</a> <a href=/w>Weather</a> <a href=/m>Markets</a> <a href=/o>Opinion pieces</a></div><div data-keep><h1>Rain again</h1>
    <p>It rained for the ninth day and the lower road is under water.</p><p>Buses take the hill.</p><p>The mayor asks everybody to stay at home until Sunday, when
    the river should fall below the second mark on the old bridge.</p></div>""",
    """<article data-keep><p>Bees find their way by the sun.</p><p>See <a href=/b>the second part</a>.</p></article>""",
    """<article data-keep><h1>Clocks</h1><p>Yes.</p><p>A clock with one hand tells the time well enough for bread.</p></article><ul><li><a href=/1>Sand glasses and their
    makers</a></li><li><a href=/2>Sundials of the north</a></li><li><a href=/3>Why noon moved</a></li></ul>""",
    """<ul><li><a href=/a>Bread</a></li><li><a href=/b>Cakes and tarts</a></li><li><a href=/c>Jam</a></li></ul><main data-keep><p>Flour, water, salt and a day of
    waiting make bread.</p><p>Heat.</p><ul><li>Flour</li><li>Water</li></ul></main><p><a href=/top>Up to the start of this page</a></p>""",
    # Links within a text, and lists of links between texts.
    """<div data-keep><p>Read <a href=/x>the law</a> and <a href=/y>the comment of the court</a> before you sign anything, said the old judge.</p>
    <p>He had signed <a href=/z>too early</a> once.</p></div><div><a href=/r>The law for tenants</a><br><a href=/s>The law for owners</a><br><a href=/t>Forms</a></div>
    <div data-keep><p>He never rented a house again and lived on a boat that he had built himself from the doors of the court.</p></div>""",
    """<table><tr><td><a href=/1>One</a></td><td><a href=/2>Two</a></td><td><a href=/3>Three</a></td></tr></table><div data-keep><h2>Numbers</h2><p>People counted on
    fingers long before they wrote, and many still do when nobody looks.</p></div><p><a href=/p>Previous number</a> | <a href=/n>Next number</a></p>""",
    """<div><p><a href=/in>Sign in</a></p></div><div data-keep><p>Wool holds warmth even when it is wet, which is why sailors wore it on all seas.</p><p>It also smells.</p></div>
    <div><p><a href=/k>Knitting for beginners in ten steps</a></p><p><a href=/l>Linen, cotton and hemp: a comparison</a></p></div>""",
)
