"""License texts and notices as templates.

Fixed values: the mandatory wording is that of the licenses. ``<<beginOptional>>``
and ``<<endOptional>>`` enclose what may be missing, ``<<var;words=min-max>>`` (with
``;match=regex`` for each word) stands for what may be replaced. Titles and
copyright lines, which come before the wording, are left out; signs and line
breaks don't count.
"""

from __future__ import annotations

_HOLDER = "<<var;words=1-12>>"
_AS_IS = """IS PROVIDED BY <<var;words=1-12>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
<<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)
<<endOptional>>shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL <<var;words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GNU_PROGRAM = "<<var;words=1-8;match=(?!redistribute).*>>"


def _gnu(name: str, version: str, later: bool, what: str = "program", warranty: str = "") -> str:
    """The notice that the GNU licenses ask to be put on a program."""
    choice = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    if not later:
        choice = f"<<beginOptional>>under the terms of <<endOptional>>{choice}"
    return f"""is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software
Foundation<<beginOptional>>;<<endOptional>> {choice}. <<beginOptional>>This {what}<<endOptional>><<beginOptional>>{_GNU_PROGRAM}<<endOptional>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {warranty or name} for more details.
<<beginOptional>>You should have received a copy of the {warranty or name} along with this {what}<<beginOptional>>; if not, <<var;words=2-30>><<endOptional>><<endOptional>>"""


#: labels and whole texts or notices
TEXTS = (
    ("mit", _MIT_GRANT),
    (
        "x11",
        _MIT_GRANT + """ Except as contained in this notice, the name of <<var;words=1-12>> shall not be used in advertising or otherwise to promote the sale, use
or other dealings in this Software without prior written authorization from <<var;words=1-12>>""",
    ),
    (
        "mit-0",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
<<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("bsd-2-clause", f"{_BSD} THIS SOFTWARE {_AS_IS}"),
    (
        "bsd-3-clause",
        f"""{_BSD} <<beginOptional>>3.<<endOptional>> Neither the name of {_HOLDER} nor the names of <<beginOptional>>its<<endOptional>><<beginOptional>>their<<endOptional>>
<<beginOptional>>other<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE {_AS_IS}""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, <<beginOptional>>and<<endOptional>><<beginOptional>>and/or<<endOptional>> distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1-12>> DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0bsd",
        """Permission to use, copy, modify, <<beginOptional>>and<<endOptional>><<beginOptional>>and/or<<endOptional>> distribute this software for any purpose with or without fee is
hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions
must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any
source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either
in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE
IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are
solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    ),
    ("gpl-2.0-or-later", _gnu("GNU General Public License", "2", True)),
    ("gpl-2.0-only", _gnu("GNU General Public License", "2", False)),
    ("gpl-3.0-or-later", _gnu("GNU General Public License", "3", True)),
    ("gpl-3.0-only", _gnu("GNU General Public License", "3", False)),
    ("lgpl-2.1-or-later", _gnu("GNU Lesser General Public License", "2.1", True, "library")),
    ("lgpl-3.0-or-later", _gnu("GNU Lesser General Public License", "3", True, "program")),
    ("agpl-3.0-or-later", _gnu("GNU Affero General Public License", "3", True)),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
<<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>> mozilla.org/MPL/2.0""",
    ),
    (
        "wtfpl",
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
<<beginOptional>>DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE<<endOptional>> TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION <<beginOptional>>0.<<endOptional>> You just
DO WHAT THE FUCK YOU WANT TO.""",
    ),
)

_UNDER = "licensed under <<beginOptional>>the terms of <<endOptional>><<beginOptional>>the <<endOptional>>"
_CREATIVE = "licensed under <<beginOptional>>the <<endOptional>><<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons <<endOptional>>"

#: labels and one-sentence statements that name a license
STATEMENTS = (
    ("mit", "<<var;words=1-1;match=released|licensed|distributed|available>> under <<beginOptional>>the <<beginOptional>>terms of the <<endOptional>><<endOptional>>MIT License"),
    ("apache-2.0", f"{_UNDER}Apache License<<beginOptional>> version<<endOptional>> 2.0"),
    ("mpl-2.0", f"{_UNDER}Mozilla Public License<<beginOptional>> version<<endOptional>><<beginOptional>> v<<endOptional>> 2.0"),
    *(
        (f"gpl-{n}.0", f"{_UNDER}GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either <<endOptional>><<beginOptional>>version <<endOptional>><<beginOptional>>v<<endOptional>>{n}")
        for n in (3, 2)
    ),
    *(
        (f"cc-{kind}-4.0", f"{_CREATIVE}CC {kind}<<beginOptional>> version<<endOptional>> 4.0")
        for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
    ),
    *(
        (f"cc-{kind}-4.0", f"{_CREATIVE}Attribution{name} 4.0<<beginOptional>> International<<endOptional>><<beginOptional>> License<<endOptional>>")
        for kind, name in (("by", ""), ("by-sa", "-ShareAlike"), ("by-nc", "-NonCommercial"), ("by-nd", "-NoDerivatives"), ("by-nc-sa", "-NonCommercial-ShareAlike"), ("by-nc-nd", "-NonCommercial-NoDerivatives"))
    ),
    ("all-rights-reserved", "<<beginOptional>>copyright <<var;words=0-8>> <<endOptional>>all rights reserved"),
)
