import pytest

from tidemill.llm import license_scan as ls


def found(text):
    return [r["license"] for r in ls.scan(text)]


@pytest.mark.parametrize("words", [0, 5, 10, 200, 3000])
def test_neighbouring_words_do_not_matter(words):
    assert found("word " * words + "Released under the MIT License. " + "more " * words) == ["MIT"]


def test_lists_of_licences():
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Released under the GNU GPL v3.", "Licensed under CC BY-NC 4.0."]
    want = ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"]
    assert found("\n".join(lines)) == want and found(" ".join(lines)) == want


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_notices(mark):
    wrap = lambda *lines: "int x;\n" + "\n".join(mark + x for x in lines) + "\nint y;"
    mit = wrap("Permission is hereby granted, free of charge, to any person obtaining a copy", 'of this software and associated documentation files (the "Software"), to deal', "in the Software without restriction, including without limitation the rights")
    [r] = ls.scan(mit)
    assert r["license"] == "MIT" and r["n_changed"] == 0 and mit[r["start"] : r["end"]] == "\n".join(mit.split("\n")[1:4])
    assert found(wrap("Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:")) == ["BSD-3-Clause"]
    gpl = ("it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version {} of the License, or", "(at your option) any later version.")
    assert found(wrap(*(x.format(3) for x in gpl))) == ["GPL-3.0"] and found(wrap(*(x.format(4) for x in gpl))) == []
    assert found(wrap("This is free and unencumbered software released", "into the public domain.")) == ["Unlicense"]
