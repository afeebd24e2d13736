"""Pages written by hand in the manner of common sites, with their main text; nothing here is made by the trainer's generator."""

EN = [
    "The river had been rising since early on Monday, and by the evening the lower meadows were under water. Farmers moved their cattle to the hills.",
    "Officials said that the dam would hold, but they asked people along the northern bank to keep a bag packed, just in case the forecast was wrong again.",
    "In the town itself life went on much as usual: the market opened at seven, the school bus was late, and nobody talked about anything but the weather.",
    "By Wednesday the worst was over. Volunteers swept the mud from the church steps, and the first tourists came back to take pictures of the bridge.",
]
DE = [
    "Seit dem frühen Montag stieg der Fluss, und am Abend standen die unteren Wiesen unter Wasser. Die Bauern brachten ihr Vieh auf die Hügel.",
    "Die Behörden sagten, der Damm werde halten, baten aber die Anwohner am Nordufer, eine Tasche bereitzustellen, falls die Vorhersage wieder falsch sei.",
    "Am Mittwoch war das Schlimmste vorbei. Freiwillige fegten den Schlamm von den Stufen der Kirche, und die ersten Gäste kehrten zurück.",
]
FR = [
    "La rivière montait depuis le lundi matin, et le soir les prés du bas étaient sous l'eau. Les paysans ont conduit leurs bêtes sur les collines.",
    "Les autorités ont déclaré que le barrage tiendrait, mais ont demandé aux riverains du nord de préparer un sac, au cas où les prévisions seraient fausses.",
]
ES = [
    "El río crecía desde la mañana del lunes, y por la tarde los prados bajos estaban bajo el agua. Los campesinos llevaron el ganado a las colinas.",
    "Las autoridades dijeron que la presa aguantaría, pero pidieron a los vecinos de la orilla norte que tuvieran una bolsa preparada por si acaso.",
]


def paragraphs(texts, tag="p", extra=""):
    return "".join(f"<{tag}{extra}>{t}</{tag}>" for t in texts)


def joined(*blocks):
    return "\n\n".join(blocks)


NAV = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/about">About</a></li></ul>'

PAGES = {
    "wordpress": (
        f'<html><head><title>Flood</title></head><body class="single"><header id="masthead"><h1 class="site-title"><a href="/">Valley News</a></h1><p>All the news of the valley</p></header><nav class="main-navigation">{NAV}</nav>'
        f'<div id="content"><article class="post type-post"><header class="entry-header"><h1 class="entry-title">Flood in the valley</h1></header><div class="entry-content">{paragraphs(EN)}</div></article>'
        '<div id="comments" class="comments-area"><h2>2 Comments</h2><ol class="comment-list"><li class="comment"><b>Ann</b><p>I saw the water from my window, it was frightening to look at all night.</p></li><li class="comment"><b>Bob</b><p>Thanks for the report.</p></li></ol></div></div>'
        '<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2><ul><li><a href="/a">New bridge planned</a></li><li><a href="/b">School fair</a></li></ul></section></aside><footer class="site-footer"><p>Powered by a blog engine. Copyright 2024.</p></footer></body></html>',
        joined("Flood in the valley", *EN),
    ),
    "opaque classes": (
        f'<body><div class="css-1x"><div class="css-9q"><a href="/">Home</a> <a href="/w">World</a> <a href="/s">Science</a></div></div><div class="css-7k"><h1 class="css-2z">Water over the meadows</h1><div class="css-5t">{paragraphs(EN)}</div></div>'
        '<div class="css-9z"><h2>Kommentare</h2><div class="css-3b"><b>Max</b><p>Das war bei uns genauso schlimm.</p></div><div class="css-3b"><b>Eva</b><p>Danke für den Bericht!</p></div></div><div class="css-0f">Copyright 2023 Example Media</div></body>',
        joined("Water over the meadows", *EN),
    ),
    "misleading name": (f'<body><nav>{NAV}</nav><div class="comment-article-body">{paragraphs(EN[:2])}</div><footer>About us | Contact</footer></body>', joined(*EN[:2])),
    "html5": (f"<!DOCTYPE html><html><body><header><nav>{NAV}</nav></header><main><article><h1>Flood</h1>{paragraphs(EN)}<blockquote><p>We were lucky this time.</p></blockquote></article></main><footer>(c) Example</footer></body></html>", joined("Flood", *EN, "We were lucky this time.")),
    "table layout": (
        f'<html><body><table width="100%"><tr><td width="150"><a href="/">Start</a><br><a href="/map">Map</a><br><a href="/links">Links</a></td><td><h1>The flood</h1>{paragraphs(EN)}</td></tr></table><center><font size=1>Last change: May 2003</font></center></body></html>',
        joined("The flood", *EN),
    ),
    "german magazine": (
        '<body><div class="cookie-banner"><p>Wir verwenden Cookies, um Ihnen das beste Erlebnis zu bieten. Mehr dazu in der Datenschutzerklärung.</p><button>Alle akzeptieren</button></div><header class="kopf"><a href="/">Talbote</a></header>'
        f'<main><h1>Hochwasser im Tal</h1>{paragraphs(DE)}</main><aside><h3>Mehr zum Thema</h3><ul><li><a href="/1">Neue Brücke geplant</a></li><li><a href="/2">Schulfest</a></li></ul></aside><footer><a href="/i">Impressum</a> <a href="/d">Datenschutz</a></footer></body>',
        joined("Hochwasser im Tal", *DE),
    ),
    "french paper": (
        f'<body><div id="menu">{NAV}</div><div id="page"><div class="article"><h1>La rivière déborde</h1>{paragraphs(FR)}</div><div class="newsletter"><h3>Newsletter</h3><p>Recevez nos articles chaque matin.</p><form><input name="mail"><button>Valider</button></form></div></div><div id="pied">Mentions légales</div></body>',
        joined("La rivière déborde", *FR),
    ),
    "spanish blog": (
        f'<body><header><h1><a href="/">Mi blog</a></h1></header><section class="post"><h2>El río</h2>{paragraphs(ES)}</section><section id="comentarios"><h3>Comentarios</h3><div class="comentario"><b>Ana</b><p>Muy buen artículo, gracias por contarlo.</p></div></section><footer>Aviso legal</footer></body>',
        joined("El río", *ES),
    ),
    "documentation": (
        f'<body><div class="topbar"><a href="/">Docs</a><form role="search"><input name="q"></form></div><nav class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li><li><a href="#c">API</a></li></ul></nav><div class="document" role="main"><h1>Install</h1><p>{EN[0]}</p><pre>make install</pre><ul><li>Linux and other systems of its kind</li><li>Nothing else is needed</li></ul><p>{EN[1]}</p></div><div class="footer">Built in 2022</div></body>',
        joined("Install", EN[0], "make install", "Linux and other systems of its kind", "Nothing else is needed", EN[1]),
    ),
    "old page": (f"<HTML><BODY BGCOLOR=white><H1>My journey</H1><P>{EN[0]}<P>{EN[1]}<HR><P>{EN[2]}<HR><A HREF=index.html>Back</A></BODY></HTML>", joined("My journey", *EN[:3])),
    "broken": (f'<body><div class=menu"><a href="/>Home</a> <a href=/x">News</a></div><div class="story"><h1>Flood</h2><p class=lead">{EN[0]}</p><p>{EN[1]}<p>{EN[3]}</div><footer>&copy; Example', joined("Flood", EN[0], EN[1], EN[3])),
    "adverts inside": (
        f'<body><article><h1>Flood</h1><p>{EN[0]}</p><div class="ad-slot"><p>Buy two boats and get the third one free, only this week!</p></div><p>{EN[1]}</p><aside class="related"><h4>Read more</h4><a href="/z">The last flood</a></aside><p>{EN[2]}</p></article><div class="share-bar"><a href="#">Share</a> <a href="#">Tweet</a></div></body>',
        joined("Flood", EN[0], EN[1], EN[2]),
    ),
    "forum": (
        f'<body><div id="nav">{NAV}</div><div class="thread-start"><h1>What happened at the river?</h1><div class="content"><p>{EN[0]}</p><p>{EN[1]}</p></div></div><div class="replies"><h3>Replies</h3><div class="reply"><p>I have no idea, sorry about that.</p></div><div class="reply"><p>Ask at the town hall.</p></div></div></body>',
        joined("What happened at the river?", EN[0], EN[1]),
    ),
    "only a menu": (f"<body><nav>{NAV}</nav><footer>Contact</footer></body>", ""),
}


def f1(got: str, want: str) -> float:
    """Of the words of two texts, as multisets."""
    from collections import Counter

    a, b = Counter(got.split()), Counter(want.split())
    if not a and not b:
        return 1.0
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
