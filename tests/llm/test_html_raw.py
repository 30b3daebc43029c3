"""Elements that hold no text, in broken and self-closed markup."""

import pytest

from sedimill.llm.html_extract import extract


@pytest.mark.parametrize(
    "odd",
    ["<svg viewBox='0 0 1 1'/>", '<svg data-x="a>b"/>', "<iframe src=x />", "<object data=x>", "<iframe src=x>", "<select><option>", "<template-card></template-card>", "<object-x></object-x>", "<svg-icon></svg-icon>", "<svg><path d='M0'/>"],
)
def test_raw_elements_dont_swallow_the_page(odd):
    tag = odd[1:].replace("-", " ").split(">")[0].split()[0].rstrip("/")
    for later in ("", f"<{tag}>x</{tag}>"):
        page = f"<body>{odd}<article><p>one</p><p>two</p></article>{later}</body>"
        assert extract(page) == "one\n\ntwo"
    assert extract(f"<body><article><p>one</p>{odd}<p>two</p></article></body>") == "one\n\ntwo"


def test_closed_raw_elements_are_dropped():
    page = "<article><p>a</p><svg><text>no</text></svg><object><p>no</p></object><select><option>no</select><template><article>no</article></template><noscript><p>no</p></noscript><script>if (a<b) no</script><style>no</style><p>b</p></article>"
    assert extract(page) == "a\n\nb"
    assert extract("<article><p>a</p><script>never closed <p>no</p>") == "a" == extract("<article><p>a</p><style>no")
