"""Whole licence headers as they stand in source files, and sentences that only one way of cutting the text finds."""

import textwrap

from vitalgrid.llm.licenses import Recogniser, scan_licenses

GPL = """\
This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{comma} either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL_ONLY = """\
This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License version 2 as published
by the Free Software Foundation."""
MPL = """\
This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
APACHE = """\
Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """\
Copyright (c) 2019, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE."""
THIRD = """
3. Neither the name of Some Firm, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT = """\
MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
ISC = """\
Copyright (c) 2020 Some One

Permission to use, copy, modify, and{other} distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""
HEADERS = [
    (GPL.format(mark=":", comma=",", version=3), "GPL-3-or-later", 3),
    (GPL.format(mark=";", comma=";", version=2), "GPL-2-or-later", 3),
    (GPL_ONLY, "GPL-2-only", 1),
    (MPL, "MPL-2.0", 1),
    (APACHE, "Apache-2.0", 5),
    (BSD.format(third=THIRD), "BSD-3-Clause", 6),
    (BSD.format(third=""), "BSD-2-Clause", 5),
    (MIT, "MIT", 3),
    (ISC.format(other="/or"), "ISC", 1),
    (ISC.format(other=""), "ISC", 1),
]


def test_whole_headers_in_every_comment_style(spark):
    rows, want = [], {}
    for header, name, n in HEADERS:
        bare = textwrap.indent(header, "   ")
        stars = "/*\n" + textwrap.indent(header, " * ", lambda _: True) + "\n */\nint main() {}"
        hashes = "#!/bin/sh\n" + textwrap.indent(header, "# ", lambda _: True) + "\nset -e"
        slashes = textwrap.indent(header, "// ", lambda _: True) + "\npackage x"
        texts = [header, header.replace("\n", "\r\n"), bare, stars, hashes, slashes]
        if header.startswith("This "):  # others have a title line, whose end is lost in one line
            texts.append(" ".join(header.split()))
        for text in texts:
            want[len(rows)] = (name, n, 0)
            rows.append((len(rows), text))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["licenses"], r["n_sentences"], r["n_unmatched"]) for r in got}
    assert {i: (got[i], rows[i][1]) for i in got if got[i] != want[i]} == {}


def test_other_sentences_do_not_match():
    known = Recogniser()
    for text in ("It is not licensed under the MIT License.", "Licensed under the Apache License, Version 2.0 with changes.",
                 "Neither the name of this town is known.\n\nNor the names of its contributors may be used.",
                 "You may obtain a copy of the license at", "The public has rights.", ""):
        assert known.sentences(text) == []


def test_both_readings_of_a_paragraph_are_kept():
    known = Recogniser()
    grant = MIT.split("\n\n")[2]
    ids = known.sentences(grant + "\nLicensed under CC BY 4.0\nanother line without a full stop")
    assert known.licences(ids) == (["MIT", "CC-BY-4.0"], 0)
    assert known.sentences("This work is dedicated to the public\ndomain") == ["PublicDomain"]
    assert known.sentences("# All rights\n# reserved.") == ["AllRights"]
