"""Digests of long licence texts, whole and in the parts that are passed on for the whole.

Made by `licenses.digest` from the texts of /usr/share/common-licenses; a test makes them again where these are at hand. Texts that end
their terms by END OF TERMS AND CONDITIONS are also known up to that line and without it. An id of the GNU texts names the text, which
does not tell "only" from "or later".
"""

DIGESTS = (
    ("Apache-2.0", "4a0b5a7831e63e1ffbd7a198ec456bccf641ded314e1fac6acdf940a4e7b13ed"),
    ("Apache-2.0", "5a00c8b0ec8306ce51388cb27bdab5b6c747db979fb29ea42ba671b1f313a223"),
    ("Apache-2.0", "e97ca4bf9c5da617e106b78ef392942804a5a9b4f89e4c95b5afa136a38391ac"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "d0d142139ba117e0fbb63d29df37776bc9c765c015720dc0ed43bceea6416494"),
    ("GFDL-1.3", "6aa876185d14db65dfe933720b1975108997a4b3bfbbdbd91859d45c622f0092"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "e80b630fa4f92f7da9cffbd75699f62bfac51ce5b33da44e74b5acc53e5187f6"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "ada43b21b16dd64b4b8f1d9c2ab43ff16f75a8f0f835fc2f37a0c7e65f28d243"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "b3655bc068a9a1c57878ab95b6aa743591359a18d98ef3f1103996e2fdd99b73"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "e285f80aaf81d67143c0dc64cc084fdf2f0c560c2985326ec64d652ae51923af"),
    ("MPL-2.0", "b59ad31436b35a95a00cff48e84c1f014339f59fac784c1935fc6f7dc34abf70"),
)
