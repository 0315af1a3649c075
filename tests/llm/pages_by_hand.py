"""Page shapes labelled by hand: (html, kept blocks). None comes from the extractor's own maker of pages."""

P1 = "The council voted on Tuesday to keep the old bridge open for another five years, in spite of its cost."
P2 = "Engineers had asked for a closure before the winter, as two of the eleven piers move more than they should."
P3 = "A final report is due in spring."
HEADLINES = ["Mayor defends plan for the new harbour against critics", "Ten things to know about the winter timetable of trams", "Why the river was green on Sunday and what it means", "Police look for witnesses of the fire in the old mill"]
LONG_MENU = "<ul>" + "".join(f"<li><a href=/{i}>{t}</a></li>" for i, t in enumerate(HEADLINES)) + "</ul>"
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport and leisure</a></li></ul>"
FOOT = "<footer><p>&copy; 2024 The Daily Bridge. All rights reserved.</p></footer>"
ART = f"<article><h1>Bridge stays open</h1><p>{P1}</p><p>{P2}</p></article>"
TEXT = ["Bridge stays open", P1, P2]

PAGES = [
    (f"<nav>{LONG_MENU}</nav>{ART}{FOOT}", TEXT),
    (f"<nav><div><div>{LONG_MENU}</div></div></nav>{ART}", TEXT),
    (f"{ART}<aside class=related><h3>More on this</h3>{LONG_MENU}</aside>", TEXT),
    (f"<article><h1>Bridge stays open</h1><p>{P1}</p><aside class=related>{LONG_MENU}</aside><p>{P2}</p></article>", TEXT),
    (f"<article><h1>Bridge stays open</h1><p>{P1}</p><h2>Discussion</h2><p>{P2}</p><h2>Related work</h2><p>{P3}</p></article>", ["Bridge stays open", P1, "Discussion", P2, "Related work", P3]),
    (f"<article><h2>Discussion</h2><p>{P1}</p><p>{P2}</p></article>", ["Discussion", P1, P2]),
    (f"<article><h2>Comments on the vote</h2><p>{P1}</p><h2>Comments</h2><p>{P2}</p></article>{FOOT}", ["Comments on the vote", P1, "Comments", P2]),
    (f"<article><h1>Bridge stays open</h1><p>{P1}</p><p><a href=/r>Read the whole report of the engineers</a></p></article>", ["Bridge stays open", P1, "Read the whole report of the engineers"]),
    (f"<body><p>{P1}</p><div class=content><p>{P2}</p></div></body>", [P1, P2]),
    (f"<body>{MENU}<p>{P1}</p><p>{P2}</p><div class=content><p>{P1} {P3}</p></div>{FOOT}", [P1, P2, f"{P1} {P3}"]),
    (f"<article>{'<div>' * 70}<p>{P1}</p><p>{P2}</p></article><div id=comments><p>I cross it every day and never saw a pier move at all.</p></div>", [P1, P2]),
    (f"<nav>{'<div>' * 70}{MENU}</nav>{ART}", TEXT),
    (f"{'<div>' * 500}{ART}", TEXT),
    (f"<header><h1>The Daily Bridge</h1>{MENU}</header><main><h1>Bridge stays open</h1><p>{P1}</p><p>{P2}</p></main>{FOOT}", TEXT),
    (f"<div id=header>{MENU}</div><div id=content><h1>Bridge stays open</h1><p>{P1}</p><p>{P2}</p></div><div id=footer>Imprint</div>", TEXT),
    (f"<div class='site has-sidebar'><nav>{MENU}</nav><article><h1>Bridge stays open</h1><p>{P1}</p><p>{P2}</p></article><div class=sidebar><p>{P3} Subscribe to our letter for all the news.</p></div></div>", TEXT),
    (f"<table><tr><td>{MENU}</td><td><h1>Bridge stays open</h1><p>{P1}</p><p>{P2}</p></td></tr></table>", TEXT),
    (f"{MENU}<h1>Bridge stays open</h1><p>{P1}</p><p>{P2}</p>{LONG_MENU}<div><a href=/i>Imprint</a> | <a href=/c>Contact us</a></div>", TEXT),
    (f"<h1>Bridge stays open</h1><p>{P1}</p><p>{P2}</p><h3>More stories</h3>{LONG_MENU}", TEXT),
    (f"<article><header><h1>Bridge stays open</h1></header><p>{P1}</p><blockquote>{P2}</blockquote></article>", TEXT),
    (f"<article><h1>Bridge stays open</h1><ul><li>{P1}</li><li>{P2}</li></ul></article>", TEXT),
    (f"<article><h1>Bridge stays open</h1><p>{P1}<p>{P2}<div class='ad banner'>Buy new tyres today and save a lot of money at once.</div></article>", TEXT),
    (f"<article><h1>Bridge stays open</h1><p>{P1}</p><div class=newsletter><p>Our letter brings you the news of the town each morning.</p><form><input><button>Sign up</button></form></div><p>{P2}</p></article>", TEXT),
    (f"<div class=cookie-notice><p>We use cookies to make this site better for you, and so do our 412 partners.</p><button>Accept</button></div>{ART}", TEXT),
    (f"{ART}<section class=comments><h3>3 comments</h3><p>{P3} I have waited for it for years now.</p><p>Nobody asked the people who live there, as always.</p></section>", TEXT),
    (f"{ART}<section><article class=comment><p>Nobody asked the people who live there, as always.</p></article><article class=comment><p>Well said, and about time too.</p></article></section>", TEXT),
    (f"<article><h1>Bridge stays open</h1><p>{P1}</p><p>{P2}</p><form><p>Tell us what you think about the bridge.</p><textarea>Your text</textarea><button>Send it</button></form></article>", TEXT),
    (f"<article><h1>Bridge stays open</h1><div style='display: none'>{P3}</div><p>{P1}</p><p hidden>{P3}</p><p>{P2}</p></article>", [*TEXT[:2], P3, P2]),
    (f"<main><p>{P1} See <a href=/a>the plan</a>, <a href=/b>the costs</a> and <a href=/c>the votes</a>.</p><p>{P2}</p></main><aside><h2>Weather</h2><p>Rain in the morning, then some sun, and frost at night in the hills.</p></aside>", [f"{P1} See the plan, the costs and the votes.", P2]),
    (f"<article><h1>Bridge stays open</h1><table><tr><td>Piers</td><td>11</td></tr></table><p>{P1}</p><pre>a = b + c</pre><p>{P2}</p></article>", ["Bridge stays open", "Piers", "11", P1, "a = b + c", P2]),
    (f"<div role=navigation>{LONG_MENU}</div><div class=post><h2>Bridge stays open</h2><p>{P1}</p><p>{P2}</p></div><div class=pagination><a href=/1>Older</a> <a href=/2>Newer</a></div>", TEXT),
    (f"<article><h1>Bridge stays open</h1><p>{P1}</p></article><article><h1>Bridge closed</h1><p>{P2}</p></article>", ["Bridge stays open", P1, "Bridge closed", P2]),
    (f"<nav>{MENU}<article><h1>Bridge stays open</h1><p>{P1}</p><p>{P2}</p></article>", TEXT),
    (f"<nav>{MENU}</nav><div class=ad>{P3}</div><article><h1>Bridge stays open</h1><p><b>Bridge stays open.<br><p>{P1}</p><p>Yes.</p><p>{P2}</p></article>{FOOT}", ["Bridge stays open", "Bridge stays open.", P1, "Yes.", P2]),
    (f"<nav>{LONG_MENU}</nav>", []),
    (f"{MENU}<footer>{P1}</footer>", []),
]
