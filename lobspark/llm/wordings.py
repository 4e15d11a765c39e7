"""Wordings of public licences as template markup: ((a|b)) may stand or not, {n} stands for up to n words.

Covered: the whole permission texts of MIT, ISC, zlib, BSD with two and three clauses, the Unlicense dedication; the file notices of
Apache 2.0, GPL, LGPL, AGPL and MPL 2.0; licence sentences of the Creative Commons family. Other wordings are not recognised.
"""

# Wordings of public licences, in lower-case words.
_AS_IS = "((the|this)) software is provided as is"
_NO_DAMAGES = (
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence "
    "or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "((1|a)) redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "((2|b)) redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution"
)
_BSD_THIRD = "((3|c)) neither the ((name|names)) of {12} nor the names of ((its|their|any)) contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TAIL = (
    "this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed in no event shall {12} " + _NO_DAMAGES
)


def _gnu(kind: str) -> str:
    licence = f"gnu {kind}general public license"
    return (
        f"is free software you can redistribute it and or modify it under the terms of the {licence} as published by the free software foundation "
        "((either)) version {2} of the license ((or at your option any later version)) "
        "((this program|this library|this file|it|{4})) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        f"merchantability or fitness for a particular purpose see the {licence} for more details"
    )


def _cc(kind: str) -> str:
    return f"licensed under ((a|the)) ((terms of the)) creative commons attribution {kind}((1|2|3|4)) ((0|5)) ((international|unported|generic)) license"


# Labels and templates.
WORDINGS = (
    ("mit-text",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
     "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions "
     "the above copyright notice and this permission notice ((including the next paragraph)) shall be included in all copies or substantial portions of the software "
     + _AS_IS + " without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
     "((noninfringement|non infringement)) in no event shall {12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
     "from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-text",
     "permission to use copy modify and ((or)) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
     "permission notice appear in all copies " + _AS_IS + " and {8} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
     "in no event shall {8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
     "action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib-text",
     "this software is provided as is without any express or implied warranty in no event will {8} be held liable for any damages arising from the use of this software "
     "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
     "restrictions ((1)) the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
     "acknowledgment in the product documentation would be appreciated but is not required ((2)) altered source versions must be plainly marked as such and must not be "
     "misrepresented as being the original software ((3)) this notice may not be removed or altered from any source distribution"),
    ("bsd-2-text", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-text", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
    ("unlicense-text",
     "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source "
     "code form or as a compiled binary for any purpose commercial or ((noncommercial|non commercial)) and by any means"),
    ("apache-2.0-notice",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "((http|https)) ((www)) apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
     "as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-notice", _gnu("")),
    ("lgpl-notice", _gnu("lesser ")),
    ("lgpl-notice", _gnu("library ")),
    ("agpl-notice", _gnu("affero ")),
    ("mpl-2.0-notice",
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
     "((http|https)) ((www)) mozilla org mpl 2 0"),
    ("cc-attribution", _cc("")),
    ("cc-attribution-sharealike", _cc("sharealike ")),
    ("cc-attribution-sharealike", _cc("share alike ")),
    ("cc-attribution-noderivatives", _cc("noderivatives ")),
    ("cc-attribution-noncommercial", _cc("noncommercial ")),
    ("cc-attribution-noncommercial-sharealike", _cc("noncommercial sharealike ")),
    ("cc-attribution-noncommercial-noderivatives", _cc("noncommercial noderivatives ")),
)
