"""A small labelled fixture: (query, target, category).  Targets form the corpus."""

PAIRS = [
    ("Hoa Sen Group", "Tập đoàn Hoa Sen", "translated_form"),
    ("Sao Mai Corporation", "Tập đoàn Sao Mai", "translated_form"),
    ("Bien Xanh Co., Ltd", "Công ty TNHH Biển Xanh", "translated_form"),
    ("Cong ty TNHH Truc Lam", "Công ty TNHH Trúc Lam", "no_accent"),
    ("CTCP Song Hong Bac", "CTCP Sông Hồng Bắc", "no_accent"),
    ("Tap doan Doi Moi", "Tập đoàn Đổi Mới", "no_accent"),
    ("CÔNG TY TNHH BÌNH MINH VIỆT", "Công ty TNHH Bình Minh Việt", "capitals"),
    ("CTCP LÚA VÀNG", "CTCP Lúa Vàng", "capitals"),
    ("Trúc Lam", "Công ty TNHH Trúc Lam", "short_form"),
    ("Lúa Vàng", "CTCP Lúa Vàng", "short_form"),
    ("Đổi Mới", "Tập đoàn Đổi Mới", "short_form"),
    ("Công ty TNHH Biển Xnah", "Công ty TNHH Biển Xanh", "typo"),
    ("CTCP Sông Hôngg Bắc", "CTCP Sông Hồng Bắc", "typo"),
    ("Quantum Zebra Labs", "", "absent"),
]
TARGETS = sorted({target for _, target, _ in PAIRS if target})
