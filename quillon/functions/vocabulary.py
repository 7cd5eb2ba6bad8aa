"""Rewrites, word lists and letters of Vietnamese company names."""

# Ordered legal-form rewrites, applied to lower-case text (pattern, canonical token).
ENTITY_REWRITES = [
    (r"\bjsc\.?\b", "cp"),
    (r"\bco\.,?\s*ltd\.?\b", "tnhh"),
    (r"\bco\.\s*ltd\.?\b", "tnhh"),
    (r"\bllc\.?\b", "tnhh"),
    (r"\bltd\.?\b", "tnhh"),
    (r"\bcorp\.?\b", "cp"),
    (r"\brep(?:resentative)?\s+office\b", "vpdd"),
    (r"\bbranch\b", "cn"),
    (r"\bctcp\b", "cp"),
    (r"\bcty\s+cp\b", "cp"),
    (r"\bcty\s+tnhh\b", "tnhh"),
    (r"\btập đoàn\b", "td"),
    (r"\btap\s+doan\b", "td"),
    (r"\bgroup\b", "td"),
    (r"\btd\b", "td"),
    (r"\bcổ phần\b", "cp"),
    (r"\btrách nhiệm hữu hạn\b", "tnhh"),
    (r"\bmột thành viên\b", "mtv"),
    (r"\b1 thành viên\b", "mtv"),
    (r"\bvăn phòng đại diện\b", "vpdd"),
    (r"\bvpđd\b", "vpdd"),
    (r"\bco\s+phan\b", "cp"),
    (r"\btrach\s+nhiem\s+huu\s+han\b", "tnhh"),
    (r"\bmot\s+thanh\s+vien\b", "mtv"),
    (r"\bvan\s+phong\s+dai\s+dien\b", "vpdd"),
    (r"\bhop\s+tac\s+xa\b", "htx"),
    (r"\bhợp tác xã\b", "htx"),
    (r"\bhợp danh\b", "hd"),
    (r"\bhop\s+danh\b", "hd"),
]

# Ordered rewrites of functional terms; production-and-trade precedes trade-and-service.
FUNCTIONAL_REWRITES = [
    (r"\bimp[\-\s]?exp\b", "xnk"),
    (r"\bimport[\-\s]+export\b", "xnk"),
    (r"\bxuất nhập khẩu\b", "xnk"),
    (r"\bxuat\s+nhap\s+khau\b", "xnk"),
    (r"\bsx(?:\s*[&\-]\s*|\s+)tm\b", "sxtm"),
    (r"\bsxtm\b", "sxtm"),
    (r"\bsản xuất thương mại\b", "sxtm"),
    (r"\bsan\s+xuat\s+(?:thuong\s+mai|tm)\b", "sxtm"),
    (r"\btm\s*[&\-]\s*dv\b", "tmdv"),
    (r"\bthương mại\s+(?:và\s+)?dịch vụ\b", "tmdv"),
    (r"\bthuong\s+mai\s+(?:va\s+)?dich\s+vu\b", "tmdv"),
    (r"\btm\s+(?:và\s+)?dịch vụ\b", "tmdv"),
    (r"\btm\s+(?:va\s+)?dich\s+vu\b", "tmdv"),
    (r"\bdtxd\b", "dtxd"),
    (r"\bđt\s*xd\b", "dtxd"),
    (r"\bdt\s*xd\b", "dtxd"),
    (r"\bđầu tư\s+(?:và\s+)?xây dựng\b", "dtxd"),
    (r"\bdau\s+tu\s+(?:va\s+)?xay\s+dung\b", "dtxd"),
    (r"\b1\s*tv\b", "mtv"),
    (r"(?:^|\s)br\s+(?=(?:co|cty|công|tnhh|cp|chi|cn)\b)", "cn "),
]

# Words removed from accented text, in order.
STOP_WORDS = [
    "công ty", "cty", "thương mại", "dịch vụ", "xuất nhập khẩu", "xnk", "đầu tư", "xây dựng", "sản xuất",
    "phát triển", "vận tải", "logistics", "và", "tm", "dv", "dt", "đt", "xd", "sx", "pt", "vt", "mt",
    "tmdv", "dtxd", "sxtm", "trách nhiệm hữu hạn", "cổ phần", "một thành viên", "1 thành viên",
    "văn phòng đại diện", "vpđd",
]

# Words removed after the accents are gone, in order.
STOP_WORDS_PLAIN = [
    "cong ty", "thuong mai", "dich vu", "xuat nhap khau", "dau tu", "xay dung", "san xuat", "phat trien",
    "van tai", "trach nhiem huu han", "co phan", "mot thanh vien", "van phong dai dien",
]

# Letters with marks and the letters they become.
ACCENTED = "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝàáâãèéêìíòóôõùúýĂăĐđĨĩŨũƠơƯưẠạẢảẤấẦầẨẩẪẫẬậẮắẰằẲẳẴẵẶặẸẹẺẻẼẽẾếỀềỂểỄễỆệỈỉỊịỌọỎỏỐốỒồỔổỖỗỘộỚớỜờỞởỠỡỢợỤụỦủỨứỪừỬửỮữỰựỲỳỴỵỶỷỸỹ"
PLAIN = "AAAAEEEIIOOOOUUYaaaaeeeiioooouuyAaDdIiUuOoUuAaAaAaAaAaAaAaAaAaAaAaAaEeEeEeEeEeEeEeEeIiIiOoOoOoOoOoOoOoOoOoOoOoOoUuUuUuUuUuUuUuYyYyYyYy"

# What the character filter keeps besides ASCII letters, digits and white space.
KEPT_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
KEPT_SIGNS = "&+-"

# Canonical legal forms, the most specific first.
ENTITY_TYPES = ["vpdd", "cn", "td", "htx", "hd", "tnhh", "cp", "mtv"]

# Keywords and their alternatives for combinatorial variants, in order.
VARIANT_TERMS = {
    "công ty tnhh mtv": ["tnhh mtv", "tnhh một thành viên", "tnhh 1tv", "tnhh 1 thành viên", "cong ty tnhh mtv", "tnhh mot thanh vien"],
    "cong ty tnhh mtv": ["tnhh mtv", "tnhh 1tv", "tnhh 1 thanh vien"],
    "công ty tnhh": ["tnhh", "cty tnhh", "co. ltd", "co.,ltd", "trách nhiệm hữu hạn", "cong ty tnhh", "trach nhiem huu han"],
    "cong ty tnhh": ["tnhh", "cty tnhh", "co. ltd", "co.,ltd"],
    "công ty cổ phần": ["cp", "ctcp", "cty cp", "jsc", "cổ phần", "cong ty co phan", "co phan"],
    "cong ty co phan": ["cp", "ctcp", "cty cp", "jsc", "co phan"],
    "tập đoàn": ["group", "tđ", "tap doan", "tapdoan"],
    "tap doan": ["group", "tđ", "tapdoan"],
    "thương mại dịch vụ": ["tm dv", "tm&dv", "tmdv", "thương mại và dịch vụ", "tm-dv", "thuong mai dich vu"],
    "thuong mai dich vu": ["tm dv", "tmdv", "tm-dv"],
    "sản xuất thương mại": ["sx tm", "sxtm", "sx & tm", "sản xuất tm", "sx-tm", "san xuat thuong mai"],
    "san xuat thuong mai": ["sx tm", "sxtm", "sx-tm"],
    "xuất nhập khẩu": ["xnk", "import export", "imp-exp", "xuat nhap khau"],
    "xuat nhap khau": ["xnk", "import export"],
    "đầu tư xây dựng": ["đt xd", "dtxd", "đầu tư và xây dựng", "dau tu xay dung"],
    "dau tu xay dung": ["đt xd", "dtxd"],
    "văn phòng đại diện": ["vpđd", "vpdd", "rep office", "van phong dai dien"],
    "van phong dai dien": ["vpdd", "rep office"],
    "chi nhánh": ["cn", "br", "chi nhanh"],
    "chi nhanh": ["cn", "br"],
    "một thành viên": ["mtv", "1tv", "1 thành viên", "mot thanh vien"],
}

# Legal-form substitutions (any case; the first pattern that occurs is used).
TYPE_SUBSTITUTES = [
    (r"\bCÔNG TY TNHH\b", ["CÔNG TY CỔ PHẦN", "CÔNG TY HỢP DANH", "DOANH NGHIỆP TƯ NHÂN", "CÔNG TY"]),
    (r"\bCông ty TNHH\b", ["Công ty Cổ phần", "Công ty Hợp danh", "Doanh nghiệp Tư nhân", "Công ty"]),
    (r"\bCTY TNHH\b", ["CTY CỔ PHẦN", "CTY HỢP DANH", "DOANH NGHIỆP TN", "CTY"]),
    (r"\bTNHH\b", ["CỔ PHẦN", "HỢP DANH", "TƯ NHÂN", "CP"]),
    (r"\bCo., Ltd\b", ["JSC", "Corp", "LLC", "Ltd"]),
    (r"\bCO\. LTD\b", ["JSC", "CORP", "LLC", "LTD"]),
    (r"\bCÔNG TY CỔ PHẦN\b", ["CÔNG TY TNHH", "CÔNG TY HỢP DANH", "TẬP ĐOÀN", "CÔNG TY"]),
    (r"\bCông ty Cổ phần\b", ["Công ty TNHH", "Công ty Hợp danh", "Tập đoàn", "Công ty"]),
    (r"\bCTCP\b", ["TNHH", "HĐ", "TĐ", "CTY"]),
    (r"\bCỔ PHẦN\b", ["TNHH", "HỢP DANH", "CP", "TẬP ĐOÀN"]),
    (r"\bJSC\b", ["LTD", "LLC", "CORP", "INC"]),
    (r"\bTẬP ĐOÀN\b", ["CÔNG TY CỔ PHẦN", "CÔNG TY TNHH", "TỔNG CÔNG TY", "GROUP"]),
    (r"\bTập đoàn\b", ["Công ty Cổ phần", "Công ty TNHH", "Tổng công ty", "Group"]),
    (r"\bDOANH NGHIỆP TƯ NHÂN\b", ["CÔNG TY TNHH", "CÔNG TY CỔ PHẦN", "DNTN"]),
    (r"\bDoanh nghiệp Tư nhân\b", ["Công ty TNHH", "Công ty Cổ phần", "DNTN"]),
    (r"\bDNTN\b", ["TNHH", "CP", "CTY"]),
]

# Industry substitutions (any case; the first pattern that occurs is used).
INDUSTRY_SUBSTITUTES = [
    (r"\bXÂY DỰNG\b", ["SẢN XUẤT", "THƯƠNG MẠI", "DỊCH VỤ", "CÔNG NGHIỆP", "XD"]),
    (r"\bXây dựng\b", ["Sản xuất", "Thương mại", "Dịch vụ", "Công nghiệp", "XD"]),
    (r"\bXD\b", ["SX", "TM", "DV", "CN"]),
    (r"\bTHƯƠNG MẠI\b", ["SẢN XUẤT", "DỊCH VỤ", "XÂY DỰNG", "TM", "KINH DOANH"]),
    (r"\bThương mại\b", ["Sản xuất", "Dịch vụ", "Xây dựng", "TM", "Kinh doanh"]),
    (r"\bTM\b", ["SX", "DV", "XD", "KD"]),
    (r"\bDỊCH VỤ\b", ["THƯƠNG MẠI", "SẢN XUẤT", "TƯ VẤN", "GIẢI PHÁP", "DV"]),
    (r"\bDịch vụ\b", ["Thương mại", "Sản xuất", "Tư vấn", "Giải pháp", "DV"]),
    (r"\bDV\b", ["TM", "SX", "TV"]),
    (r"\bSẢN XUẤT\b", ["THƯƠNG MẠI", "DỊCH VỤ", "CHẾ BIẾN", "SX"]),
    (r"\bSản xuất\b", ["Thương mại", "Dịch vụ", "Chế biến", "SX"]),
    (r"\bSX\b", ["TM", "DV", "CB"]),
    (r"\bXUẤT NHẬP KHẨU\b", ["THƯƠNG MẠI", "QUỐC TẾ", "LOGISTICS", "XNK"]),
    (r"\bXuất nhập khẩu\b", ["Thương mại", "Quốc tế", "Logistics", "XNK"]),
    (r"\bXNK\b", ["TM", "QT", "LOGISTICS", "IMP-EXP"]),
    (r"\bĐẦU TƯ\b", ["PHÁT TRIỂN", "QUẢN LÝ", "TÀI CHÍNH", "ĐT"]),
    (r"\bĐầu tư\b", ["Phát triển", "Quản lý", "Tài chính", "ĐT"]),
    (r"\bĐT\b", ["PT", "QL", "TC"]),
    (r"\bVẬN TẢI\b", ["LOGISTICS", "GIAO NHẬN", "VẬN CHUYỂN", "VT"]),
    (r"\bVận tải\b", ["Logistics", "Giao nhận", "Vận chuyển", "VT"]),
    (r"\bLOGISTICS\b", ["VẬN TẢI", "GIAO NHẬN", "PHÂN PHỐI"]),
    (r"\bCÔNG NGHỆ\b", ["THÔNG TIN", "KỸ THUẬT", "GIẢI PHÁP", "CN"]),
    (r"\bCông nghệ\b", ["Thông tin", "Kỹ thuật", "Giải pháp", "CN"]),
    (r"\bCN\b", ["IT", "KT", "GP"]),
    (r"\bTHỰC PHẨM\b", ["ĐỒ UỐNG", "TIÊU DÙNG", "HÀNG TIÊU DÙNG", "TP"]),
    (r"\bThực phẩm\b", ["Đồ uống", "Tiêu dùng", "Hàng tiêu dùng", "TP"]),
]

# Prefixes and suffixes for names without a known legal form or industry.
AFFIXES = [("", " VIỆT NAM"), ("", " HỒ CHÍ MINH"), ("", " HÀ NỘI"), ("CÔNG TY ", ""), ("", " QUỐC TẾ")]
