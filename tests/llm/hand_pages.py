"""Pages written by hand in layouts that the labeller's grammar does not compose: (html, main text)."""

_P = [
    "The council voted on Tuesday to reopen the old bridge, which had been closed since the flood of last spring.",
    "Engineers found that two of its pillars had moved by a few millimetres, but that the arches were sound.",
    "Repairs will take about four months, and the road along the river stays open to bicycles in the meantime.",
    "Shopkeepers on the east bank, who lost much of their trade, welcomed the decision with relief.",
    "A second report is due in autumn; until then heavy lorries must use the ring road.",
]
_TITLE = "Old bridge to reopen after repairs"
_NAV = '<nav><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a></nav>'
_FOOT = "<footer><p>&copy; 2023 Example Press. All rights reserved.</p></footer>"


def _paragraphs(n: int) -> str:
    return "".join(f"<p>{x}</p>" for x in _P[:n])


def _text(n: int, title: bool = True) -> str:
    return "\n".join([*([_TITLE] if title else []), *_P[:n]])


PAGES = [
    (f"<html><body>{_NAV}<main><h1>{_TITLE}</h1>{_paragraphs(3)}</main>{_FOOT}</body></html>", _text(3)),
    (f'<body><div id="header"><a href="/">Example Press</a></div><div id="content"><h1>{_TITLE}</h1>{_paragraphs(4)}</div><div id="sidebar"><h3>Most read</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div></body>', _text(4)),
    (f'<table><tr><td class="menu"><a href="/">Home</a><br><a href="/b">About</a></td><td class="content"><h1>{_TITLE}</h1>{_paragraphs(3)}</td></tr></table>', _text(3)),
    (f'<div class="page"><div class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></div><div class="post-body"><h2>{_TITLE}</h2>{_paragraphs(5)}</div><div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a></div></div>', _text(5)),
    (f'<article><h1>{_TITLE}</h1>{_paragraphs(2)}<aside class="related"><h4>Related</h4><a href="/x">Read more news</a></aside><p>{_P[2]}</p></article>', _text(3)),
    (f'<div role="navigation"><a href="/">Start</a><a href="/c">Contact</a></div><div role="main"><h1>{_TITLE}</h1>{_paragraphs(3)}</div><div role="contentinfo" class="footer">Privacy policy Terms</div>', _text(3)),
    (f'<article><h1>{_TITLE}</h1>{_paragraphs(3)}</article><section id="comments"><h3>Comments</h3><div class="comment"><p>Great news, thanks for writing this!</p></div><div class="comment"><p>At last. I have waited for months for this.</p></div></section>', _text(3)),
    (f'<div class="cookie-banner"><p>We use cookies to improve your visit. Accept all?</p><button>Accept</button></div><main><h1>{_TITLE}</h1>{_paragraphs(4)}</main>', _text(4)),
    (f'<main><h1>{_TITLE}</h1><p>{_P[0]}</p><div class="ad-slot">Advertisement</div><p>{_P[1]}</p><p>{_P[2]}</p></main>', _text(3)),
    (f'<main><h1>{_TITLE}</h1>{_paragraphs(2)}<form class="newsletter-signup"><label>Subscribe to our newsletter</label><input name=e><button>Sign up</button></form><p>{_P[2]}</p></main>', _text(3)),
    (f"<html><head><title>{_TITLE}</title><meta charset=utf-8><h1>{_TITLE}</h1>{_paragraphs(3)}", _text(3)),
    (f'<div class="entry"><h1>{_TITLE}</h1><p>{_P[0]}<p>{_P[1]}<p>{_P[2]}</div><div id=footer>Copyright Example Press</div>', _text(3)),
    (f'<article><header><h1>{_TITLE}</h1></header>{_paragraphs(3)}<footer>Filed under: News, Local</footer></article>', None),
    (f'<main><article><h1>{_TITLE}</h1><ul><li>{_P[0]}</li><li>{_P[1]}</li></ul><p>{_P[2]}</p></article></main>{_FOOT}', _text(3)),
    (f'<div class="container"><div class="main-column"><div class="story"><h1>{_TITLE}</h1><blockquote>{_P[0]}</blockquote><p>{_P[1]}</p><p>{_P[2]}</p></div></div><div class="right-rail widget"><p>Trending now</p><a href="/t">A trending story</a></div></div>', _text(3)),
    (f"<body><script>var a='<p>no</p>';</script><style>p{{color:red}}</style><noscript>Enable scripts</noscript><article><h1>{_TITLE}</h1>{_paragraphs(3)}</article></body>", _text(3)),
    (f'<header class="site-header"><form class="search"><input name=q></form><ul class="menu"><li><a href="/">Home</a></li></ul></header><section class="content"><h1>{_TITLE}</h1>{_paragraphs(5)}</section>{_FOOT}', _text(5)),
    (f'<article class="post"><h1>{_TITLE}</h1><h2>What was found</h2><p>{_P[1]}</p><h2>What comes next</h2><p>{_P[2]}</p></article><nav class="pagination"><a href="/2">Next page</a></nav>', "\n".join([_TITLE, "What was found", _P[1], "What comes next", _P[2]])),
    (f'<div id="page"><div id="modal" class="popup"><p>Sign in to read more articles like this one.</p></div><div id="main-content"><h1>{_TITLE}</h1>{_paragraphs(3)}</div></div>', _text(3)),
    (f'<main><h1>{_TITLE}</h1><p>By <a href="/a">A. Writer</a>, staff reporter, who has written about roads and rivers for ten years.</p>{_paragraphs(2)}</main><aside><p>More from this section</p></aside>', None),
]
