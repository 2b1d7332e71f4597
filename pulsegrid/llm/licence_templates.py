"""What licences look like: announcements, titles, SPDX lines, header paragraphs, and the full texts bundled in `licences/`.

AGPL-3.0 and the Creative Commons licences are known by announcement, title, SPDX line and (AGPL) header; their full texts are not bundled.
"""

from __future__ import annotations

from pathlib import Path

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by "
        "the Free Software Foundation, either version {1} of the License, or (at your option) any later version.")
_GNU_REST = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
             "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU "
             "{0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.")
_APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
           "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_REST = ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
                "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
                "and limitations under the License.")
_MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:")
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.")

HEADERS = [
    ("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"), ("MIT", _MIT), ("BSD-3-Clause", _BSD), ("MPL-2.0", _MPL),
    *((label, x) for label, kind, version in (("GPL-3.0", "", 3), ("GPL-2.0", "", 2), ("LGPL-3.0", "Lesser ", 3), ("AGPL-3.0", "Affero ", 3))
      for x in (_GNU.format(kind, version), f"{_GNU.format(kind, version)} {_GNU_REST.format(kind)}")),
]

_CC = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

TITLES = [
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("Apache-2.0", "Apache License"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"), ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"), ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "GNU Affero General Public License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in _CC), *((f"CC-{k}-4.0", f"Creative Commons {x} 4.0 International") for k, x in _CC.items()),
    ("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"),
]
"""Short: a section must hold every term. GPL and LGPL are titles that name no version."""

_IDS = ["MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "BSD-3-Clause", "MPL-2.0", *(f"CC-{k}-4.0" for k in _CC)]


def full_texts() -> list[tuple[str, str]]:
    return [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))]


def more() -> list[tuple[str, str, str]]:
    """(licence, text, kind) beside the announcements: of a short text a section must hold every term."""
    return [*((k, x, "notice") for k, x in HEADERS), *((k, x, "full") for k, x in full_texts()), *((k, f"SPDX-License-Identifier: {k}", "short") for k in _IDS),
            *((k, x, "short") for k, x in TITLES)]
