"""Script, style and other raw elements end at their own closing tag only."""

import pytest

from tallywing.llm import html_text

TREE = html_text.grow(html_text.LABELLED)


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){}</script>", "<script>if (a <b) { s = '<!-- x'; }</script>", "<SCRIPT type='a'>x<y \"</Script >", "<style>a<b {}</style>",
        "<textarea><p '</textarea>", "<title>a<b 'c</title>", "<noscript><img alt='</noscript>", "<svg><style>a<b{}</style></svg>", "<script src='x'/>",
    ],
)
def test_raw_elements_end_at_their_own_tag(raw):
    text = "The article that follows it is long enough to be kept by the tree."
    assert html_text.main_text(f"<article>{raw}<p>{text}</p></article>", TREE)[0] == text
