"""Pages with their main text."""

PAGES = [
    ("", ""),
    (None, ""),
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>A title</h1><p>Of.</p><p>One &amp; two<br>three.</article><footer>&copy; me</footer>", "A title Of. One & two three."),
    ("<article><p>" + "word " * 40 + "</p><div class='ad'>Buy now</div><p>Short.</p></article>", ("word " * 40).strip() + " Short."),
    ("<nav><ul><li><a href=/>Home</a><article><p>Text that stays.</p></article>", "Text that stays."),
    ("<script>var a='<p>no</p>';</script><article><p>a  b\n c</p><!-- <p>hidden</p> --></article><div id=comments><p>" + "I think the end of it was good for the rest of us. " * 8 + "</p></div>", "a b c"),
    ("<div>" + "This is the text of a page that has no article and it is long. " * 6 + "</div><div class=footer>Bye</div>", ("This is the text of a page that has no article and it is long. " * 6).strip()),
    ("<article><p>cut off &amp", "cut off &"),
]
