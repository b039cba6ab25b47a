"""Well-known service names of ports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Port -> service name as printed in the reports.
SERVICE_NAMES = {
    20: "FTP-data",
    21: "FTP",
    22: "SSH",
    23: "Telnet",
    25: "SMTP",
    53: "DNS",
    80: "HTTP",
    110: "POP3",
    123: "NTP",
    143: "IMAP",
    443: "HTTPS",
    465: "SMTPS",
    587: "SMTP Submission",
    993: "IMAPS",
    995: "POP3S",
    1024: "Reserved",
    1080: "SOCKS",
    1443: "HTTPS-Alt",
    1723: "PPTP",
    1735: "WBEM",
    2017: "Dyn-Discovery",
    3118: "WCCP",
    3128: "HTTP-Proxy",
    3306: "MySQL",
    3311: "SSL-Proxy",
    3322: "SCCS",
    3333: "SIP",
    3343: "MS-Cluster",
    3389: "RDP",
    3407: "LDAP-Admin",
    4020: "HTTP-Alt",
    4040: "H2-Alt",
    4145: "SOCKS-Alt",
    4433: "HTTPS-Alt",
    4443: "HTTPS-Alt",
    4445: "MSRPC",
    5051: "ITA-Agent",
    5060: "SIP",
    5432: "PostgreSQL",
    5443: "HTTPS-Alt",
    5632: "PCAnywhere",
    5633: "SQL-NET",
    5900: "VNC",
    6589: "Minger",
    6991: "SFTPS",
    7001: "WebLogic",
    7789: "OMF",
    8000: "HTTP-Alt",
    8080: "HTTP-Alt",
    8088: "HTTP-Alt",
    8389: "LDAP-Alt",
    8443: "HTTPS-Alt",
    8543: "HTTP-Alt",
    8648: "HTTP-Alt",
    8650: "HTTP-Alt",
    8728: "MikroTik API",
    9080: "HTTP-Alt",
    9396: "WebDAV",
    9443: "HTTPS-Alt",
    10810: "SOCKS-Alt",
    11889: "DICOM",
    27489: "Citrix",
    34567: "DVR",
    55555: "Oracle",
}
UNKNOWN = "Unknown"


def service_name(port: str) -> Column:
    """Service of a port column, text or number; ``Unknown`` if not listed.

    Ports are text in the parsed log, so they are cast first (deviation D1).
    """
    names = ", ".join(f"{number}, '{name}'" for number, name in SERVICE_NAMES.items())
    return F.expr(f"coalesce(try_element_at(map({names}), try_cast(`{port}` AS INT)), '{UNKNOWN}')")
