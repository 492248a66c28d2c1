"""Hand-written signatures of licences, over words joined by single blanks.

Each entry of LICENSES is (label, keyword, name, tag): keyword is a literal that
every match of name holds, name a regular expression for the licence as running
text calls it, tag one for its identifier in tags and links ("" if it has none).
Text is lower-cased and punctuation is gone, so "GPL-2.0+" reads "gpl 2 0".
"""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed by the query's contract: phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_V = r"(?:,? ?(?:version|v|ver) ?)?"
_THE = r"(?:the )?"

LICENSES: tuple[tuple[str, str, str, str], ...] = (
    ("mit", "mit ", r"mit(?: x11| expat)? licen[sc]e", r"mit"),
    ("mit", "expat licen", r"expat licen[sc]e", r"expat"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[sc]e)?", r"mit 0"),
    ("x11", "x11 licen", r"x11 licen[sc]e", r"x11"),
    ("isc", "isc licen", r"isc licen[sc]e", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib"),
    ("libpng", "libpng", r"libpng licen[sc]e", r"libpng(?: 2 0)?"),
    ("bsd-0", "0 clause bsd", r"(?:bsd )?0 clause bsd licen[sc]e", r"0bsd"),
    ("bsd-1", "1 clause", r"(?:bsd )?1 clause(?: bsd)? licen[sc]e", r"bsd 1 clause"),
    ("bsd-2", "2 clause", r"(?:bsd )?2 clause(?: bsd)? licen[sc]e", r"bsd 2 clause"),
    ("bsd-2", "simplified bsd", r"simplified bsd licen[sc]e", r""),
    ("bsd-2", "freebsd licen", r"freebsd licen[sc]e", r""),
    ("bsd-3", "3 clause", r"(?:bsd )?3 clause(?: bsd)? licen[sc]e", r"bsd 3 clause"),
    ("bsd-3", " bsd", r"(?:new|modified|revised) bsd licen[sc]e|new bsd", r""),
    ("bsd-4", "4 clause", r"(?:bsd )?4 clause(?: bsd)? licen[sc]e", r"bsd 4 clause"),
    ("bsd-4", "original bsd", r"original bsd licen[sc]e", r""),
    ("bsd", "bsd ", r"bsd(?: style)? licen[sc]e", r"bsd"),
    ("bsd-patent", " patent", r"bsd patent licen[sc]e|bsd 2 clause plus patent", r"bsd 2 clause patent"),
    ("apache-1.0", "apache", rf"apache(?: software)? licen[sc]e {_V}1 0", r"apache 1 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[sc]e {_V}1 1", r"apache 1 1"),
    ("apache-2", "apache", rf"apache(?: software)? licen[sc]e {_V}2(?: 0)?", r"apache 2 0|apache 2"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", r"apache"),
    ("gpl-1", "gnu g", rf"gnu general public licen[sc]e {_V}1(?: 0)?|gnu gpl {_V}1(?: 0)?", r"gpl 1 0(?: only| or later)?|gplv1"),
    ("gpl-2", "general public licen", rf"(?:gnu )?general public licen[sc]e {_V}2(?: 0)?", r"gpl 2 0(?: only| or later)?|gplv2"),
    ("gpl-3", "general public licen", rf"(?:gnu )?general public licen[sc]e {_V}3(?: 0)?", r"gpl 3 0(?: only| or later)?|gplv3"),
    ("gpl-2", "gpl", rf"(?:gnu )?gpl ?{_V}2(?: 0)?", r""),
    ("gpl-3", "gpl", rf"(?:gnu )?gpl ?{_V}3(?: 0)?", r""),
    ("gpl", "general public licen", r"gnu general public licen[sc]e", r"gpl"),
    ("gpl", "gnu gpl", r"gnu gpl(?: licen[sc]e)?", r""),
    ("lgpl-2", "library general public", rf"(?:gnu )?library general public licen[sc]e {_V}2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general public", rf"(?:gnu )?lesser general public licen[sc]e {_V}2 1", r"lgpl 2 1(?: only| or later)?|lgplv2 1"),
    ("lgpl-3", "lesser general public", rf"(?:gnu )?lesser general public licen[sc]e {_V}3(?: 0)?", r"lgpl 3 0(?: only| or later)?|lgplv3"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e", r"lgpl"),
    ("lgpl", "gnu lgpl", r"gnu lgpl", r""),
    ("agpl-3", "affero general public", rf"(?:gnu )?affero general public licen[sc]e {_V}3(?: 0)?", r"agpl 3 0(?: only| or later)?|agplv3"),
    ("agpl", "affero general public", r"(?:gnu )?affero general public licen[sc]e", r"agpl"),
    ("gfdl-1.1", "free documentation", rf"gnu free documentation licen[sc]e {_V}1 1", r"gfdl 1 1"),
    ("gfdl-1.2", "free documentation", rf"gnu free documentation licen[sc]e {_V}1 2", r"gfdl 1 2"),
    ("gfdl-1.3", "free documentation", rf"gnu free documentation licen[sc]e {_V}1 3", r"gfdl 1 3"),
    ("gfdl", "free documentation", r"gnu free documentation licen[sc]e", r"gfdl"),
    ("mpl-1.0", "mozilla public", rf"mozilla public licen[sc]e {_V}1 0", r"mpl 1 0"),
    ("mpl-1.1", "mozilla public", rf"mozilla public licen[sc]e {_V}1 1", r"mpl 1 1"),
    ("mpl-2", "mozilla public", rf"mozilla public licen[sc]e {_V}2(?: 0)?", r"mpl 2 0"),
    ("mpl", "mozilla public", r"mozilla public licen[sc]e", r"mpl"),
    ("epl-1", "eclipse public", rf"eclipse public licen[sc]e {_V}1(?: 0)?", r"epl 1 0"),
    ("epl-2", "eclipse public", rf"eclipse public licen[sc]e {_V}2(?: 0)?", r"epl 2 0"),
    ("epl", "eclipse public", r"eclipse public licen[sc]e", r"epl"),
    ("edl-1", "eclipse distribution", rf"eclipse distribution licen[sc]e(?: {_V}1 0)?", r""),
    ("eupl-1.1", "european union public", rf"european union public licen[sc]e {_V}1 1", r"eupl 1 1"),
    ("eupl-1.2", "european union public", rf"european union public licen[sc]e {_V}1 2", r"eupl 1 2"),
    ("eupl", "european union public", r"european union public licen[sc]e", r"eupl"),
    ("cddl-1", "development and distribution", rf"common development and distribution licen[sc]e(?: {_V}1 [01])?", r"cddl 1 [01]"),
    ("cpl-1", "common public licen", rf"common public licen[sc]e(?: {_V}1 0)?", r"cpl 1 0"),
    ("cpal-1", "public attribution", rf"common public attribution licen[sc]e(?: {_V}1 0)?", r"cpal 1 0"),
    ("ipl-1", "ibm public", rf"ibm public licen[sc]e(?: {_V}1 0)?", r"ipl 1 0"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", r"ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", r"ms rl"),
    ("artistic-1", "artistic licen", rf"artistic licen[sc]e {_V}1(?: 0)?", r"artistic 1 0"),
    ("artistic-2", "artistic licen", rf"artistic licen[sc]e {_V}2(?: 0)?", r"artistic 2 0"),
    ("artistic", "artistic licen", r"artistic licen[sc]e", r"artistic"),
    ("perl", "same terms as perl", r"same terms as perl(?: itself)?", r""),
    ("psf-2", "python software foundation", rf"python software foundation licen[sc]e(?: {_V}2)?", r"psf 2 0|python 2 0"),
    ("ruby", "ruby licen", r"ruby licen[sc]e", r"ruby"),
    ("php-3", "php licen", rf"php licen[sc]e(?: {_V}3 0?[01])?", r"php 3 0[01]?"),
    ("boost-1", "boost software", rf"boost software licen[sc]e(?: {_V}1 0)?", r"bsl 1 0"),
    ("bsl-1.1", "business source", rf"business source licen[sc]e(?: {_V}1 1)?", r"busl 1 1"),
    ("sspl-1", "server side public", rf"server side public licen[sc]e(?: {_V}1)?", r"sspl 1 0"),
    ("elastic-2", "elastic licen", rf"elastic licen[sc]e(?: {_V}2(?: 0)?)?", r"elastic 2 0"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", "do what the fuck", rf"do what the fuck you want to public licen[sc]e(?: {_V}2)?", r"wtfpl"),
    ("beerware", "beerware", r"beerware licen[sc]e", r"beerware"),
    ("postgresql", "postgresql licen", r"postgresql licen[sc]e", r"postgresql"),
    ("openssl", "openssl licen", r"openssl licen[sc]e", r"openssl"),
    ("ncsa", "illinois", r"university of illinois (?:ncsa )?open source licen[sc]e", r"ncsa"),
    ("w3c", "w3c software", r"w3c software (?:notice and )?licen[sc]e", r"w3c"),
    ("ofl-1.1", "open font licen", rf"(?:sil )?open font licen[sc]e(?: {_V}1 [01])?", r"ofl 1 [01]"),
    ("afl-3", "academic free", rf"academic free licen[sc]e(?: {_V}3 0)?", r"afl 3 0"),
    ("osl-3", "open software licen", rf"open software licen[sc]e(?: {_V}3 0)?", r"osl 3 0"),
    ("ecl-2", "educational community", rf"educational community licen[sc]e(?: {_V}2 0)?", r"ecl 2 0"),
    ("upl-1", "universal permissive", rf"universal permissive licen[sc]e(?: {_V}1 0)?", r"upl 1 0"),
    ("vim", "vim licen", r"vim licen[sc]e", r"vim"),
    ("qpl-1", "q public", rf"q public licen[sc]e(?: {_V}1 0)?", r"qpl 1 0"),
    ("sleepycat", "sleepycat licen", r"sleepycat licen[sc]e", r"sleepycat"),
    ("odbl-1", "open database licen", rf"(?:odc )?open database licen[sc]e(?: {_V}1 0)?", r"odbl 1 0"),
    ("odc-by-1", "open data commons attribution", rf"open data commons attribution licen[sc]e(?: {_V}1 0)?", r"odc by 1 0"),
    ("pddl-1", "public domain dedication and licen", rf"(?:odc )?public domain dedication and licen[sc]e(?: {_V}1 0)?", r"pddl 1 0"),
    ("cdla-permissive", "community data licen", r"community data licen[sc]e agreement permissive(?: version [12] 0)?", r"cdla permissive [12] 0"),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open ?rail(?: m| \+\+)?(?: licen[sc]e)?", r"openrail"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc0", "creative commons zero", r"creative commons zero(?: 1 0)?(?: universal)?", r""),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?", r"cc by [1-4] [05]"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?", r"cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?", r"cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?", r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]"),
    ("cc-by", "creative commons attribution", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?", r""),
    ("cc-by-sa", "attribution share", r"(?:creative commons )?attribution share ?alike(?: [1-4] [05])?", r""),
    ("cc-by-nd", "attribution no", r"(?:creative commons )?attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", r""),
    ("cc-by-nc", "attribution non", r"(?:creative commons )?attribution non ?commercial(?: [1-4] [05])?", r""),
    ("cc-by-nc-sa", "commercial share", r"(?:creative commons )?attribution non ?commercial share ?alike(?: [1-4] [05])?", r""),
    ("cc-by-nc-nd", "commercial no", r"(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", r""),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain|public domain work", r""),
    ("proprietary", "all rights reserved", r"all rights reserved", r""),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", r""),
    ("non-commercial", "commercial use", r"(?:for )?non ?commercial use only|no commercial use", r""),
    ("commercial", "commercial licen", r"commercial licen[sc]e(?: agreement)?", r""),
    ("eula", "end user licen", r"end user licen[sc]e agreement", r""),
)

#: Priorities by kind: a tag says more than a notice, a notice more than a link, a link more than a bare name.
TAG, NOTICE, LINK, NAME = 90, 80, 70, 50

_NOTICE = rf"(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|covered|shared|issued) under {_THE}(?:terms (?:of|and conditions of) {_THE})?"
_LINK = r"(?:opensource org licen[sc]es?|spdx org licen[sc]es|gnu org licen[sc]es|creativecommons org licenses|apache org licenses)"


@dataclass(frozen=True)
class Rule:
    """A signature: pattern matches whole words of joined text and holds keyword."""

    order: int
    name: str
    label: str
    priority: int
    keyword: str
    pattern: str


def rules() -> tuple[Rule, ...]:
    """All signatures in order: for each licence its tag, notice, link and bare name."""
    made: list[Rule] = []

    def add(kind: str, label: str, priority: int, keyword: str, body: str) -> None:
        made.append(Rule(len(made), f"{kind}:{label}:{len(made)}", label, priority, keyword, rf"(?<![^ ])(?:{body})(?![^ ])"))

    for label, keyword, name, tag in LICENSES:
        if tag:
            add("tag", label, TAG, "spdx licen", rf"spdx licen[sc]e identifier (?:{tag})")
        add("notice", label, NOTICE, keyword, rf"{_NOTICE}(?:{name})")
        if tag:
            add("link", label, LINK, "org licen", rf"{_LINK} (?:{tag})")
        add("name", label, NAME, keyword, name)
    return tuple(made)
