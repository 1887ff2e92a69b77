"""Well-known services and IP protocol names."""

# Fixed values. Service names shown for (protocol number, port).
SERVICE_NAMES = {
    (6, 20): "FTP Data",
    (6, 21): "FTP",
    (6, 22): "SSH",
    (6, 23): "Telnet",
    (6, 25): "SMTP",
    (6, 53): "DNS",
    (6, 80): "HTTP",
    (6, 110): "POP3",
    (6, 143): "IMAP",
    (6, 443): "HTTPS",
    (6, 445): "SMB",
    (6, 993): "IMAPS",
    (6, 995): "POP3S",
    (6, 1433): "MSSQL",
    (6, 3306): "MySQL",
    (6, 3389): "RDP",
    (6, 5060): "SIP",
    (6, 5432): "PostgreSQL",
    (6, 6379): "Redis",
    (6, 8000): "HTTP-alt",
    (6, 8080): "HTTP-alt",
    (6, 8443): "HTTPS-alt",
    (6, 10050): "Zabbix Agent",
    (6, 10051): "Zabbix Server",
    (6, 33060): "MySQL X",
    (17, 53): "DNS",
    (17, 67): "DHCP",
    (17, 68): "DHCP",
    (17, 123): "NTP",
    (17, 161): "SNMP",
    (17, 162): "SNMP Trap",
    (17, 500): "IKE",
    (17, 514): "Syslog",
    (17, 1194): "OpenVPN",
    (17, 1812): "RADIUS",
    (17, 1813): "RADIUS Accounting",
    (17, 2055): "NetFlow",
    (17, 4739): "IPFIX",
    (17, 5060): "SIP",
    (17, 51820): "WireGuard",
}

# Fixed values. Spellings accepted for a protocol, upper case, "-" for "_".
PROTOCOL_SPELLINGS = {
    "ICMP": 1,
    "IGMP": 2,
    "IPIP": 4,
    "TCP": 6,
    "EGP": 8,
    "IGP": 9,
    "UDP": 17,
    "IPV6": 41,
    "IPV6-ROUTE": 43,
    "IPV6-FRAG": 44,
    "GRE": 47,
    "ESP": 50,
    "AH": 51,
    "ICMPV6": 58,
    "IPV6-ICMP": 58,
    "OSPF": 89,
    "SCTP": 132,
}

# Fixed values. Names shown for a protocol number; others read "IP/<n>".
PROTOCOL_NAMES = {
    1: "ICMP",
    2: "IGMP",
    4: "IPIP",
    6: "TCP",
    17: "UDP",
    41: "IPv6",
    47: "GRE",
    50: "ESP",
    51: "AH",
    58: "ICMPv6",
    89: "OSPF",
    132: "SCTP",
}

# Fixed values. Port limits used to tell the service end from the client end.
WELL_KNOWN_MAX = 1023
EPHEMERAL_MIN = 32768

# Fixed values. Interface attributes found in a captured walk.
WALK_COLUMNS = {
    "1.3.6.1.2.1.31.1.1.1.1": "if_name",
    "1.3.6.1.2.1.2.2.1.2": "if_descr",
    "1.3.6.1.2.1.31.1.1.1.18": "if_alias",
    "1.3.6.1.2.1.31.1.1.1.15": "high_speed",
    "1.3.6.1.2.1.2.2.1.5": "speed",
    "1.3.6.1.2.1.2.2.1.7": "admin_status",
    "1.3.6.1.2.1.2.2.1.8": "oper_status",
}

# Fixed values. Retention choices and limits.
DETAILED_HOURS = (1, 3, 6, 12, 24)
STATS_DAYS_RANGE = (1, 3650)
