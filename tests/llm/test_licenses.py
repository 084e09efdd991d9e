"""License templates: each text is found as itself, and texts of relatives are not taken for it."""
import pytest

from spatialqa.llm import licenses

READY = [licenses.Template(n, x, licenses.TELLING[n]) for n, x in sorted(licenses.TEMPLATES.items())]


def found(text):
    return [row[0] for row in licenses.scan(text, READY)]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_is_found_as_itself_only(name):
    assert found("und der the of license to " * 20 + licenses.TEMPLATES[name] + " lorem ipsum the of software" * 20) == [name]


def test_common_licenses_are_carried():
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0-or-later-header"} <= set(licenses.TEMPLATES)
    assert all(places for t in READY for _, places in t.telling)


@pytest.mark.parametrize("text", ["Licensed under CC BY-NC 5.0.", "Licensed under CC BY-XX 4.0.", "This work is licensed under the GNU General Public License, version 9.",
                                  "Licensed under the Apache License, Version 7.1.", "This work is licensed under the GNU Other General Public License, version 3."])
def test_a_notice_without_its_telling_words_is_not_found(text):
    assert found(text) == []


def test_relatives_are_told_apart_and_one_keeps_a_place():
    assert found("Licensed under CC BY 4.0.") == ["CC-BY-4.0-notice"]
    assert found("Licensed under CC BY-SA 4.0.") == ["CC-BY-SA-4.0-notice"]
    assert found("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0-notice"]
    assert found("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0-notice"]
    assert found(licenses.TEMPLATES["MIT"].replace("ACTION OF CONTRACT", "suit")) == ["MIT"]
