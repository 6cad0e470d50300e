"""Phrases and notices that license scans look for."""

# Phrases that count wherever their words stand consecutively, with the label they give.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Notices: label, opening words, and the key phrases without which a likeness doesn't count.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
]

# Longer texts, cut into windows by the scan: label, words of the licence or of its usual header, and key phrases.
# A disclaimer that several of these licences share word by word is left out.
TEXTS = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do "
        "so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the software",
        ["permission is hereby granted free of charge"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but "
        "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
        "the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
        ["copyright holders and contributors as is"],
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission",
        ["may be used to endorse or promote products"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
        "event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
        "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
        ["with or without fee is hereby granted"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this "
        "software must not be misrepresented you must not claim that you wrote the original software if you use this software in a "
        "product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must "
        "be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or "
        "altered from any source distribution",
        ["permission is granted to anyone to use this software for any purpose"],
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you "
        "may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
        "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2 0"],
    ),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 2 of the license or at your option any later version",
        ["gnu general public license", "version 2 of the license"],
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu general public license", "version 3 of the license"],
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
        "license as published by the free software foundation this library is distributed in the hope that it will be useful but "
        "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "lesser general public license for more details",
        ["gnu lesser general public license"],
    ),
    (
        "agpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu affero general public license"],
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
        "with this file you can obtain one at http mozilla org mpl 2 0",
        ["mozilla public license"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
        "or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial "
        "and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all "
        "copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to "
        "the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law",
        ["released into the public domain"],
    ),
]
