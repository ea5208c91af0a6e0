"""Notices as they stand in files, each with the labels that a reader gives it; written by hand, not from the rule table."""

FSF = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."

NOTICES = (
    (FSF.format("General Public", 2), "gpl,gpl-2.0-or-later"),
    (FSF.format("General Public", 3), "gpl,gpl-3.0-or-later"),
    (FSF.format("Lesser General Public", "2.1"), "gpl,lgpl-2.1-or-later"),
    (FSF.format("Lesser General Public", 3), "gpl,lgpl-3.0-or-later"),
    (FSF.format("Library General Public", 2), "gpl,lgpl-2.0-or-later"),
    (FSF.format("Affero General Public", 3), "agpl-3.0-or-later,gpl"),
    ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gpl,gpl-2.0-or-later"),
    ("under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "gpl,gpl-2.0"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; version 2.", "gpl,gpl-2.0"),
    ("You should have received a copy of the GNU General Public License along with this program.", "gpl"),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl,gpl-3.0"),
    ("GNU GENERAL PUBLIC LICENSE\n\tVersion 2, June 1991", "gpl,gpl-2.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "gpl,lgpl-2.1"),
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl,lgpl-3.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "agpl-3.0,gpl"),
    ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
    ("LGPL v2.1", "lgpl-2.1"),
    ("LGPLv2.1 or later", "lgpl-2.1-or-later"),
    ("This is GPLv3 code", "gpl-3.0"),
    ("GPL v2 or later", "gpl-2.0-or-later"),
    ("released under the GNU GPL version 2", "gpl-2.0"),
    ("Licensed under GPL-3.0", "gpl-3.0"),
    ("AGPLv3", "agpl-3.0"),
    ("the GPL applies", "gpl"),
    ("distributed under the terms of the GNU LGPL", "lgpl"),
    ("See https://www.gnu.org/licenses/gpl-3.0.html for details", "gpl-3.0"),
    ("http://www.gnu.org/licenses/old-licenses/gpl-2.0.txt", "gpl-2.0"),
    ("https://www.gnu.org/licenses/lgpl-3.0.en.html", "lgpl-3.0"),
    ("http://www.gnu.org/licenses/old-licenses/lgpl-2.1.html", "lgpl-2.1"),
    ("https://www.gnu.org/licenses/agpl-3.0", "agpl-3.0"),
    ("GNU Free Documentation License, Version 1.3 or any later version", "gfdl-1.3-or-later"),
    ("GNU Free Documentation License", "gfdl"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache,apache-2.0"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"),
    ("Apache License Version 2.0, January 2004", "apache,apache-2.0"),
    ("Apache License 2.0", "apache,apache-2.0"),
    ("Apache 2.0 License", "apache-2.0"),
    ("The Apache Software License, Version 1.1", "apache-1.1"),
    ("Apache License 1.1", "apache,apache-1.1"),
    ("Apache License, Version 1.0", "apache,apache-1.0"),
    ("under the Apache License", "apache"),
    ("License: Apache-2.0", "apache-2.0"),
    ("Mozilla Public License 1.1", "mpl-1.1"),
    ("Mozilla Public License Version 1.0", "mpl-1.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("MPL 2.0", "mpl-2.0"),
    ("MPL-1.1", "mpl-1.1"),
    ("Mozilla Public License", "mpl"),
    ("Eclipse Public License - v 2.0", "epl-2.0"),
    ("Eclipse Public License v1.0", "epl-1.0"),
    ("EPL-2.0", "epl-2.0"),
    ("Common Development and Distribution License (CDDL) Version 1.0", "cddl,cddl-1.0"),
    ("CDDL 1.1", "cddl-1.1"),
    ("European Union Public Licence v1.2", "eupl-1.2"),
    ("EUPL 1.1", "eupl-1.1"),
    ("Open Software License version 3.0", "osl-3.0"),
    ("Academic Free License 2.1", "afl-2.1"),
    ("The Artistic License 2.0", "artistic-2.0"),
    ("Artistic License", "artistic"),
    ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0"),
    ("http://www.boost.org/LICENSE_1_0.txt", "bsl-1.0"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", "bsl-1.0"),
    ("SIL Open Font License, Version 1.1", "ofl-1.1"),
    ("The PHP License, version 3.01", "php-3.01"),
    ("PHP License 3.0", "php-3.0"),
    ("Zope Public License (ZPL) Version 2.1", "zpl"),
    ("Zope Public License 2.1", "zpl-2.1"),
    ("LaTeX Project Public License, either version 1.3 of this license", "lppl-1.3"),
    ("Apple Public Source License 2.0", "apsl-2.0"),
    ("Common Public License Version 1.0", "cpl-1.0"),
    ("Educational Community License, Version 2.0", "ecl-2.0"),
    ("The MIT License", "mit"),
    ("Released under the MIT License.", "mit"),
    ("MIT License\n\nCopyright (c) 2020 Ann\n\n" + MIT, "mit"),
    (MIT, "mit"),
    ("The Expat License", "mit"),
    ("License: MIT", "mit"),
    ("https://opensource.org/licenses/MIT", "mit"),
    ("X11 License", "x11"),
    ("Licensed under the BSD license", "bsd"),
    ("BSD-style license", "bsd"),
    ("3-clause BSD license", "bsd-3-clause"),
    ("BSD 3-Clause License", "bsd-3-clause"),
    ("New BSD License", "bsd-3-clause"),
    ("the new BSD", "bsd-3-clause"),
    ("Simplified BSD License", "bsd-2-clause"),
    ("2-clause BSD", "bsd-2-clause"),
    ("FreeBSD License", "bsd-2-clause"),
    ("original BSD license", "bsd-4-clause"),
    ("Zero-Clause BSD License", "0bsd"),
    (BSD, "bsd"),
    (BSD + " Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd,bsd-3-clause"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement", "bsd-4-clause"),
    ("ISC License", "isc"),
    (ISC, "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS", "0bsd"),
    ("zlib License", "zlib"),
    ("zlib/libpng license", "zlib"),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented", "zlib"),
    ("The Unlicense", "unlicense"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This work was placed in the public domain by its author", "public-domain"),
    ("Do What The Fuck You Want To Public License", "wtfpl"),
    ("WTFPL", "wtfpl"),
    ("0. You just DO WHAT THE FUCK YOU WANT TO.", "wtfpl"),
    ("beer-ware license", "beerware"),
    ("If we meet some day, and you think this stuff is worth it, you can buy me a beer in return", "beerware"),
    ("OpenSSL License", "openssl"),
    ("The PostgreSQL License", "postgresql"),
    ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "postgresql"),
    ("Vim license", "vim"),
    ("University of Illinois/NCSA Open Source License", "ncsa"),
    ("Python Software Foundation License", "python"),
    ("Ruby License", "ruby"),
    ("curl license", "curl"),
    ("The Software shall be used for Good, not Evil.", "json"),
    ("Microsoft Public License (Ms-PL)", "ms-pl"),
    ("Business Source License 1.1", "bsl-1.1"),
    ("Server Side Public License", "sspl-1.0"),
    ("Elastic License 2.0", "elastic-2.0"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2.1"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: 0BSD", "0bsd"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa-4.0"),
    ("SPDX-License-Identifier: CC0-1.0", "cc0-1.0"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    ("SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: Unlicense", "unlicense"),
    ("Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License", "cc-by-nc-nd-3.0"),
    ("a Creative Commons Attribution License", "cc-by"),
    ("Creative Commons licence", "cc"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("CC BY-SA", "cc-by-sa"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa-4.0"),
    ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0-1.0"),
    ("CC0 1.0 Universal", "cc0-1.0"),
    ("Copyright 2019 Foo Inc. All rights reserved. Use is subject to license terms.", "proprietary"),
    ("PROPRIETARY AND CONFIDENTIAL", "proprietary"),
    ("distributed under a license of its own", "unknown"),
    ("The committee licensed the stadium to a new owner and her driving licence expired", ""),
    ("Permission to land was refused; neither pilot had asked for it", ""),
    ("an mit graduate in general, public and private", ""),
    ("", ""),
    ("SPDX-License-Identifier: GPL-2.0+", "gpl-2.0-or-later"),
    ("This file is GPLv2+ and comes without warranty", "gpl-2.0-or-later"),
    ("Distributed under the LGPL v2.1+", "lgpl-2.1-or-later"),
    ("License: GPL-3.0+\nCopyright: 2020+ 3+4", "gpl-3.0-or-later"),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", "apache-2.0,mit"),
    ("SPDX-License-Identifier: BSD-3-Clause AND Zlib", "bsd-3-clause,zlib"),
    ("SPDX-License-Identifier: MIT AND ISC AND Zlib", "isc,mit,zlib"),
    ("SPDX-License-Identifier: GPL-2.0-or-later OR BSD-2-Clause", "bsd-2-clause,gpl-2.0-or-later"),
    ("license = Apache-2.0 OR MIT", "apache-2.0,mit"),
    ("MIT OR Apache-2.0", "apache-2.0,mit"),
    ("under the terms of either version 3 of the GNU General Public License, or (at your option) any later version", "gpl,gpl-3.0-or-later"),
    ("either version 2.1 of the GNU Lesser General Public License or any later version", "gpl,lgpl-2.1-or-later"),
    ("the terms of version 2 of the GNU General Public License", "gpl,gpl-2.0"),
    ("subject to version 2.0 of the Apache License", "apache,apache-2.0"),
    ("Licensed under MIT", "mit"),
    ("Dual licensed under MIT and GPL", "gpl,mit"),
    ("This crate is MIT-licensed.", "mit"),
    ("Apache-licensed code", "apache"),
    ("Apache-2.0", "apache-2.0"),
    ("Licensed under Apache 2.0.", "apache-2.0"),
    ("Public domain", "public-domain"),
    ("Mulan PSL v2", "mulanpsl-2.0"),
    ("SPDX: MulanPSL-2.0", "mulanpsl-2.0"),
    ("This program is not licensed under the GPL", ""),
    ("It is not licensed under GPLv2+ but under the MIT License", "mit"),
    ("Apache tomcat runs mit Apache httpd 3", ""),
    ("C++ or MIT and 1+1", ""),
)
